"""Each operator against a brute-force version, and on nulls, empty and repeated rows, and empty tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import htmltext, language, linededup, mixing, neardup, quality, repetition, search, secrets, sentencepieces
from lexmill.llm.queries import pieces_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __size string, __key string"
EDGE = [(1, None, None, None, None, "x", "y"), (2, "", "en", "a", 0, "x", "y"), (3, " \n\t", "en", "a", 3, "x", "y"), (None, "one two", "en", None, 7, "x", "y"), (4, "é " * 3000, "fr", "a", 6000, "x", "y"), (4, "é " * 3000, "fr", "a", 6000, "x", "y")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def words(r, n, pool=400):
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def docs_frame(spark, texts, source=None):
    return spark.createDataFrame([(i, t, "en", source[i] if source else "s", len(t or ""), "x", "y") for i, t in enumerate(texts)], SCHEMA)


def test_longest_repeats_by_brute_force():
    r = random.Random(0)
    for _ in range(60):
        texts = [[r.randrange(r.choice([1, 2, 5])) for _ in range(r.randrange(0, 25))] for _ in range(3)]
        want = []
        for t in texts:
            for i in range(len(t)):
                best = 0
                for j in range(len(t)):
                    k = 0
                    while i != j and i + k < len(t) and j + k < len(t) and t[i + k] == t[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        flat = np.array([x for t in texts for x in t], np.int64)
        assert repetition.longest_repeats(flat, np.repeat(np.arange(3), [len(t) for t in texts])).tolist() == want


def test_repeat_words_and_rules(spark, edge):
    r = random.Random(1)
    texts = [words(r, 80, 30), words(r, 200), "a b c " * 40, None, ""]
    got = repetition.measures(texts)
    for t, n in zip(texts, got["n_repeat_words"], strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        assert n == len({i + d for i in range(len(w) - 2) for d in range(3) if c[tuple(w[i : i + 3])] > 1})
    rows = repetition.rule_documents(edge).collect()
    assert len(rows) == len(EDGE) and not any(x["kept"] for x in rows)
    assert repetition.rule_documents(edge.limit(0)).count() == 0


def test_sentencepiece_round_trip(spark, edge):
    import sentencepiece

    model = pieces_model()
    whole, own = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepieces.Pieces(model)
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice(" ▁ab\n\té日<s>/😀the1") for _ in range(r.randrange(1, 14)))
        ids = own.encode([t])[0]
        spans = [(int(a), int(b)) for a, b in zip(*own.spans(t, ids), strict=True)]
        assert spans == [(p.begin, p.end) for p in whole.encode(t, return_type="proto").pieces]
    rows = sentencepieces.encode_documents(edge, model).collect()
    for x, (_, t, *_) in zip(rows, EDGE, strict=True):
        ids = whole.encode(t or "")
        assert (x["n_tokens"], x["covered"]) == (len(ids), True)
        assert x["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(whole.decode(ids).encode()).hexdigest()
    full = edge.select(sentencepieces.encode_column(F.col("text"), model).alias("e")).collect()
    assert [len(x["e"]["ids"]) for x in full] == [x["n_tokens"] for x in rows]


def test_character_map():
    """A trie of ab -> x and a -> yy, built by hand in the compiled layout."""
    from types import SimpleNamespace

    units = [0] * 1024
    # root at 0 with offset 256; a at 256^97, b at its own offset
    base, a = 256, 256 ^ 97
    units[0] = base << 10
    child = 512
    units[a] = ((a ^ child) << 10) | 1 << 8 | 97
    units[child] = 0x80000000 | 2
    b = child ^ 98
    units[b] = ((b ^ 768) << 10) | 1 << 8 | 98
    units[768] = 0x80000000 | 0
    blob = len(units * 4).to_bytes(4, "little") + np.array(units, np.uint32).tobytes() + b"x\0yy\0"
    spec = SimpleNamespace(precompiled_charsmap=blob, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    made, align = sentencepieces.Normalizer(spec)(b"  ab  a ")
    assert made.decode() == "▁x▁yy"
    assert align.tolist() == [2, 2, 2, 2, 4, 4, 4, 6, 6, 7]


def test_secrets(edge):
    text = 'key1 = "abcd1234EFGH5678zz"\npassword = key1\n<client_secret>Zx81QmPw77Lk</client_secret>\nlet part = "Ab3dEf"; authToken = part + "9xYz77Qw"\nthe token: of love'
    base, spans = secrets.scan(text)
    assert base == []
    assert [text[a:b] for a, _, b in spans] == ["abcd1234EFGH5678zz", "Zx81QmPw77Lk", "Ab3dEf", "9xYz77Qw"]
    said = "secret=token: abcdef PASSWORD='hunter22' AKIA" + "A1" * 8 + " " + "0f" * 12 + " token=abc"
    base, _ = secrets.scan(said)
    assert [(k, said[a:b]) for a, k, b in base] == [("assign", "PASSWORD='hunter22"), ("access", "AKIA" + "A1" * 8), ("hex", "0f" * 12)]
    rows = secrets.scan_documents(edge).collect()
    assert len(rows) == len(EDGE) and all(x["spans"] == "" and x["n_assign"] == 0 for x in rows)


def brute_classes(texts, idf):
    w = neardup.weighted(texts, idf)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or neardup.similarity(w[i], w[j]) >= neardup.SIMILARITY:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_near_duplicates_by_brute_force(spark):
    r = random.Random(3)
    texts = []
    for _ in range(12):
        base = words(r, 120).split()
        texts.append(" ".join(base))
        for k in (0, 1, 2, 3, 6):
            copy = list(base)
            for i in r.sample(range(len(copy)), k):
                copy[i] = f"z{r.randrange(9999)}"
            texts.append(" ".join(copy))
    texts += ["", None, "a b", "a b", "a c"]
    docs = docs_frame(spark, texts)
    frequency, n = neardup.shingle_frequencies(docs.select("text"))
    want = brute_classes(texts, neardup.inverse_frequencies(frequency, n))
    got = {x["doc_id"]: x["class_id"] for x in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = neardup.keep_one_of_each(docs.union(docs))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns


def test_pairs_by_differences_lose_no_link(spark):
    """Every text in a class of its own: links and pairs together must join what brute force joins."""
    r = random.Random(5)
    texts = []
    for size in (60, 200):
        base = words(r, size, 4000).split()
        for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9) * 3:
            copy = list(base)
            for i in r.sample(range(size), k * size // 60):
                copy[i] = f"z{r.randrange(9999)}"
            texts.append(" ".join(copy))
            copy[r.randrange(size)] = "again"
            texts.append(" ".join(copy[: r.choice([size, size - 5])] + ["more"] * r.choice([0, 12])))
    texts += ["only one", "is on he " * 40, "is on he " * 45]
    docs = docs_frame(spark, texts)
    frequency, n = neardup.shingle_frequencies(docs.select("text"))
    idf = neardup.inverse_frequencies(frequency, n)
    fp = F.col("doc_id").cast("string").cast("binary")
    members = docs.select(fp.alias("fp"), F.when(F.col("doc_id") < 60, "g").otherwise("h").cast("binary").alias("g"), fp.alias("root"), "text")
    sure, pairs = (x.collect() for x in neardup.pairs_by_differences(members, idf, neardup.SIMILARITY))
    w = neardup.weighted(texts, idf)
    near = lambda a, b: neardup.similarity(w[a], w[b]) >= neardup.SIMILARITY
    assert len(sure) > 3 and all(near(int(x["a"]), int(x["b"])) for x in sure)
    root = list(range(len(texts)))
    for x in [*sure, *(x for x in pairs if near(int(x["a"]), int(x["b"])))]:
        a, b = sorted((root[int(x["a"])], root[int(x["b"])]))
        root = [a if y == b else y for y in root]
    assert root == brute_classes(texts, idf)
    assert len(pairs) < len(texts) * (len(texts) - 1) / 8


def test_near_duplicates_edges(edge):
    rows = neardup.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    assert neardup.near_duplicates(edge.limit(0)).count() == 0


def test_edit_distance(spark):
    r = random.Random(4)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abcé") for _ in range(r.randrange(24, 40)))
        b = list(a)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            k = r.randrange(len(b))
            b[k : k + r.randrange(2)] = r.choice(["", "x", "é"])
        pairs.append(tuple(sorted((a, "".join(b)), key=len)))
    pairs = [p for p in pairs if len(p[0]) >= 24 and len(p[1]) - len(p[0]) <= 2]
    rows = spark.createDataFrame(pairs, "a string, b string").select(linededup.within_edits(F.col("a"), F.col("b")).alias("got"), (F.levenshtein("a", "b") <= 2).alias("want")).collect()
    assert all(x["got"] == x["want"] for x in rows) and {x["want"] for x in rows} == {True, False}


def test_line_dedup_by_brute_force(spark, edge):
    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(5)
    pool = ["".join(r.choice("abcdef ") for _ in range(r.randrange(20, 40))) for _ in range(40)]

    def line():
        s = list(r.choice(pool))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            s[r.randrange(len(s))] = r.choice("xyz")
        return "".join(s)

    texts = ["\n".join(line() for _ in range(r.randrange(1, 8))) for _ in range(30)]
    seen, want = [], []
    for t in texts:
        gone = 0
        for s in t.split("\n"):
            if s.strip():
                long = len(s) >= linededup.MIN_CHARS
                gone += s in seen or long and any(len(x) >= linededup.MIN_CHARS and abs(len(s) - len(x)) <= 2 and far(s, x) <= 2 for x in seen)
                seen.append(s)
        want.append(gone)
    docs = docs_frame(spark, texts)
    got = {x["doc_id"]: x["n_removed"] for x in linededup.line_counts(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    left = linededup.without_repeated_lines(docs)
    assert left.columns == docs.columns and sum(x["text"].count("\n") + 1 for x in left.collect()) == sum(t.count("\n") + 1 for t in texts) - sum(want)
    rows = linededup.line_counts(edge).collect()
    assert len(rows) == len(EDGE) and all(x["n_removed"] == 0 for x in rows if x["doc_id"] != 4)
    assert linededup.line_counts(edge.limit(0)).count() == 0


def test_mixing_targets(spark, edge):
    r = random.Random(6)
    sources = [r.choice("aaaaab") if i % 7 else None for i in range(300)]
    docs = docs_frame(spark, [words(r, r.randrange(1, 30)) for _ in range(300)], sources)
    rows = mixing.mix_documents(docs).collect()
    size = Counter()
    for x in rows:
        size[sources[x["doc_id"]]] += x["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        for s in over or open_:
            target[s] = 2 * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    taken = Counter()
    for x in rows:
        s = sources[x["doc_id"]]
        assert x["source_size"] == size[s] and abs(x["target"] - target[s]) < 1e-6 and 0 <= x["taken"] <= 2 * x["size"]
        taken[s] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert len(mixing.mix_documents(edge).collect()) == len(EDGE) and mixing.mix_documents(edge.limit(0)).count() == 0
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_language_and_quality(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs, 200)
    got = language.identify_documents(docs, model).join(docs, "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()
    rows = language.identify_documents(edge, model).collect()
    assert [x["lang_pred"] for x in rows[:3]] == ["und"] * 3 and len(rows) == len(EDGE)
    assert language.identify_documents(edge.limit(0)).count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.93 * got.count()
    assert len(quality.score_documents(edge, labels.limit(0)).collect()) == len(EDGE)


def test_html(spark):
    field = htmltext.trained_field()
    wrong = total = 0
    for seed in range(9000, 9060):
        blocks, labels = htmltext.labelled_blocks(seed)
        wrong += sum(a != b for a, b in zip(field.viterbi(blocks), labels, strict=True))
        total += len(labels)
    assert wrong <= 0.02 * total
    page = '<body><nav><a href=/>x</a></nav><article><h1>T &amp; u</h1><p>One  two<br>three.<p>Four.</article><footer>&copy; z</footer>'
    want = "T & u\nOne two three.\nFour."
    assert htmltext.extract(page, field) == want
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", page)], "page_id long, url string, html string")
    assert [(x["page_id"], x["n_chars"]) for x in htmltext.extract_pages(rows).collect()] == [(1, 0), (2, 0), (3, len(want))]


def test_search_by_brute_force(spark, edge):
    r = random.Random(8)
    texts = [words(r, r.randrange(0, 60), 80) for _ in range(150)] + [None, ""]
    docs = docs_frame(spark, texts)
    got = search.search(docs, docs.where("doc_id % 20 = 0"), 5).collect()
    bags = [Counter((t or "").split()) for t in texts]
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    frequency = Counter(w for b in bags for w in b)
    idf = {w: np.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w, n in frequency.items()}
    for q in range(0, len(texts), 20):
        scores = [(round(sum(c * idf[w] * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, c in bags[q].items() if w in b), 6), -i) for i, b in enumerate(bags)]
        want = [(-i, s) for s, i in sorted(scores, reverse=True)[:5] if s > 0]
        assert [(x["doc_id"], round(x["score"], 6)) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == want
    assert search.search(edge, edge.limit(0)).count() == 0 and search.search(edge.limit(0), edge).count() == 0
