"""Line dedup, SimHash, token counts, language ID, decontamination: against brute force, and at the edges."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from subsida.llm import decontaminate, language_id, line_dedup, simhash, token_count
from subsida.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "The same long notice, which stands in many documents of this corpus."


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in texts], DOCS)


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line).strip(" \t\n\x0b\x0c\r")


def brute_lines(rows):
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and i != max(held[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines(spark):
    rng, rows = random.Random(1), []
    shared = [f"shared line number {i} which is surely longer than forty characters" for i in range(6)] + ["short", "", LINE, "ÉTÉ " * 12]
    for i in range(60):
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "  ", "\r"]) for x in rng.choices(shared, k=rng.randint(0, 8))]
        rows.append((i, "\n".join([*lines, f"own {i}"] * rng.randint(1, 2)) if i % 9 else None))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op1_line_dedup(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)
    assert sum(v[1] for v in got.values()) > 50


def test_lines_four_documents_and_repeated_rows(spark):
    same = [(i, LINE) for i in range(4)]
    assert all(r.n_dropped == 0 for r in line_dedup.op1_line_dedup(docs(spark, same + same)).collect())  # repeated rows count once
    five = line_dedup.op1_line_dedup(docs(spark, [(i, LINE + "\n" + LINE) for i in range(5)])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in five) == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 0)]


def test_lines_bitmap_runs(spark):
    text = "\n".join(["x", LINE, LINE, "y", LINE])
    runs = line_dedup.keep_bitmaps(docs(spark, [(i, text) for i in range(5)])).where("doc_id = 0").first().drop_runs
    assert [tuple(r) for r in runs] == [(1, 2), (4, 1)]


def test_lines_are_native(spark):
    plan = line_dedup.op1_line_dedup(docs(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_fingerprint(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "É A a É ß x \x0b y", "x " * 500, "The quick brown fox jumps over the lazy dog again and again"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) % (1 << 64) == brute_fingerprint(text)


def test_index_triples_meet_every_four_bytes():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))


def brute_components(fps, bits=4):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= bits):
            label[find(i + 1 + int(j))] = find(i)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("block", [8, 4096])
def test_links_connect_what_brute_force_connects(spark, block):
    rng, fps = np.random.default_rng(3), []
    for _ in range(12):  # dense groups, chains of near fingerprints, and single ones
        f = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 60))):
            fps.append(f)
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                f ^= 1 << int(b)
    fps = np.unique(np.array(fps, dtype=np.uint64))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(table, 4, block)).collect()}
    got = [roots.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = brute_components(fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_near_duplicates_and_representatives(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(3, base), (9, base), (5, base + " tail"), (8, "quite another text about other things altogether"), (1, None), (2, "  "), (None, base)]
    got = {r.doc_id: r.component_id for r in simhash.op2_simhash(docs(spark, rows)).collect()}
    assert got == {3: 3, 9: 3, 5: 3, 8: 8, 1: 1, 2: 1, None: 3}
    kept = simhash.keep_representatives(docs(spark, rows + [(3, base)]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 8]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (700, 701)], "a long, b long")
    got = {r.node: r.root for r in components(chain).collect()}
    assert got == {i: 0 for i in range(201)} | {700: 700, 701: 700}


def hf_counter():
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    pieces = token_count.load_pieces()
    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.MODEL)
    low = min(pieces.values())
    vocab = [(p, pieces.get(p, low)) for p in map(sp.id_to_piece, range(sp.get_piece_size()))]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda s: len(t.encode(s, add_special_tokens=False).ids) if s else 0


def test_token_counts_equal_the_tokenizer(spark):
    count, rng = hf_counter(), random.Random(4)
    texts = ["", " ", "  ", "a  b", " a", "a ", "\n", "a\n\nb", "\n a", "ab▁c", "日本語 текст 🙂\tx", "a" * 300, "!!!???", "  \n  x", "The cat sat on the mat."]
    texts += ["".join(rng.choices("abcdeé \n▁ß9", k=rng.randint(1, 60))) for _ in range(150)]
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs(spark, [*enumerate(texts), (-1, None)])).collect()}
    assert got == {i: count(t) for i, t in enumerate(texts)} | {-1: 0}


def test_forward_sums_all_segmentations():
    vocabulary = ["▁", "▁a", "a", "ab", "b", "▁ab"]
    p = [0.1, 0.2, 0.15, 0.25, 0.2, 0.1, language_id.UNKNOWN]

    def brute(s):
        if not s:
            return 1.0
        return sum(p[i] * brute(s[len(v) :]) for i, v in enumerate(vocabulary) if s.startswith(v)) + (p[-1] * brute(s[1:]) if s[0] not in vocabulary else 0.0)

    m = language_id.Matcher(vocabulary)
    for w in ("▁ab", "▁aab", "▁xab", "▁abba", "▁"):
        assert language_id.forward(m(w), len(w), p)[len(w)] == pytest.approx(brute(w))


def test_language_accuracy_and_held_out(spark):
    rng = random.Random(5)
    roots = {"en": ["the", "and", "water", "house", "under"], "de": ["und", "wasser", "haus", "schön", "unter"], "fr": ["avec", "l'eau", "maison", "être", "sous"]}
    rows = [(i, " ".join(rng.choice(roots[lang]) + rng.choice(["", "s", "e"]) for _ in range(30)), lang, "s", 1) for i, lang in enumerate(rng.choices(list(roots), k=240))]
    rows += [(1000, None, "en", "s", 0), (1001, "123 !!", "de", "s", 0), (1002, "", None, "s", 0), (None, "the water", "en", "s", 0)]
    got = language_id.op7_language_id(spark.createDataFrame(rows, DOCS)).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(240))
    assert sum(by[r[0]].lang_pred == r[2] for r in rows[:240] if by[r[0]].held_out) >= 0.98 * sum(by[r[0]].held_out for r in rows[:240])
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    kept = language_id.keep_identified(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == 241


def sellers(tile, text):
    row = list(range(len(text) + 1))
    row = [0] * (len(text) + 1)
    for i, c in enumerate(tile, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("aeiourstlnmd", k=rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(6)] + [(6, "short item"), (7, None)]
    rows = []
    for i in range(40):
        filler = " ".join(word() for _ in range(rng.randint(0, 40)))
        if i % 2:
            t = list(items[i % 6][1])
            for _ in range(rng.randint(0, 14)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "q"])
            filler += " " + "".join(t).upper() + " " + filler
        rows.append((i, filler))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_tiles, r.min_edits) for r in decontaminate.op9_decontamination(docs(spark, rows + [(90, None), (91, "")]), bench).collect()}
    b = decontaminate.Benchmark([(i, t.encode()) for i, t in items if t])
    want = {}
    for i, t in rows:
        x = decontaminate.normalise(np.frombuffer(t.encode(), dtype=np.uint8))
        for item, start, size in b.tiles:
            edits = sellers(b.text[start : start + size].tolist(), x.tolist()) if len(x) else 99
            if edits <= decontaminate.budget(size):
                n, e = want.get((i, b.ids[item]), (0, 99))
                want[i, b.ids[item]] = (n + 1, min(e, edits))
    assert got == want and len(want) >= 10
    kept = decontaminate.drop_contaminated(docs(spark, rows + [(90, None)]), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {d for d, _ in want} | {90}


def test_decontamination_of_long_texts_and_several_passes(spark, monkeypatch):
    passage = "a passage of the benchmark that is long enough to be told from any chance meeting of letters in a text"
    monkeypatch.setattr(decontaminate, "PIECE", 5000)
    text = "filler words and more filler " * 2000 + passage + " and further words" * 500
    bench = spark.createDataFrame([(1, passage), (2, "another item which is found in no document at all, whatever one does with it")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs(spark, [(4, text), (5, "filler " * 999)]), bench).collect()] == [(4, 1)]
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 50)
    assert [(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs(spark, [(4, text)]), bench).collect()] == [(4, 1)]


OPERATORS = {
    "lines": line_dedup.op1_line_dedup,
    "simhash": simhash.op2_simhash,
    "tokens": token_count.op4_token_count,
    "language": language_id.op7_language_id,
    "representatives": simhash.keep_representatives,
    "identified": language_id.keep_identified,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, " \t\r\n "), (4, "word " * 30_000), (5, "a"), (5, "a"), (None, "no id here"), (7, None)]
    df = docs(spark, rows).withColumns({c: F.lit(1) for c in ("h1", "pos", "fp", "key", "__id", "n_tokens", "line")})
    got = OPERATORS[name](df).collect()
    assert len(got) == {"representatives": 4, "identified": 4}.get(name, len(rows))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).collect() == []
