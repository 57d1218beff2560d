"""Feature extractors of the two classifiers against plain loops."""

import random
from collections import Counter

import numpy as np

from lexmill.llm import language, quality, search


def plain_ngrams(text):
    """Blanks for all but letters, runs of them as one, none at the beginning, and two before the text."""
    said = "".join(c if c.isalpha() else " " for c in text.lower())
    while "  " in said:
        said = said.replace("  ", " ")
    said = "  " + said.lstrip(" ")
    return Counter(said[i - n + 1 : i + 1] for i in range(2, len(said)) for n in (1, 2, 3))


def test_each_ngram_counts_once():
    r = random.Random(4)
    for text in ["a", "ab", "Ab 1 c", "é-é\n", "".join(r.choice("abé .\n7") for _ in range(500))]:
        got, want = language.ngram_counts(text), plain_ngrams(text)
        assert got.sum() == sum(want.values())
        # the same n-gram is in the same bucket, and few share one
        assert abs((got > 0).sum() - len(want)) <= max(1, len(want) // 50)
    assert language.ngram_counts("ab").sum() == 6 and (language.ngram_counts("xab") - language.ngram_counts("yab")).any()


def test_stretches_change_nothing(monkeypatch):
    text = "Um texto  com 12 palavras,\n\n e — sinais. " * 40
    whole = language.ngram_counts(text)
    for size in (1, 7, 64):
        monkeypatch.setattr(language, "_STRETCH", size)
        assert (language.ngram_counts(text) == whole).all()


def test_no_letters_no_language():
    model = language.LanguageModel(["de", "en"], np.ones(language.BUCKETS), np.zeros((language.BUCKETS, 2), np.float32), 1.0)
    assert [model.predict(t)[0] for t in (None, "", " \n12", "\U000e0041", "a")] == ["und"] * 4 + ["de"]


def test_context_pairs():
    words, text = np.array([5, 6, 7, 8, 5, 9]), np.array([0, 0, 0, 0, 1, 1])
    want = Counter((int(words[i]), int(words[j])) for i in range(6) for j in range(6) if i != j and abs(i - j) <= quality.WINDOW and text[i] == text[j])
    assert Counter(zip(*(x.tolist() for x in quality.context_pairs(words, text)), strict=True)) == want
    assert not len(quality.context_pairs(words[:0], text[:0])[0]) and not len(quality.context_pairs(words[:1], text[:1])[0])


def test_sums_of_contexts(spark):
    docs = spark.createDataFrame([("a b c a",), (None,), ("",), ("b b",)], "text string")
    sums, counts = quality.context_sums(docs)
    want, n = np.zeros_like(sums), np.zeros_like(counts)
    for t in ("a b c a", "b b"):
        b, _ = quality.words([t])
        for i, x in enumerate(b):
            n[x] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(b), i + quality.WINDOW + 1)):
                if i != j:
                    for e in range(quality.ENTRIES):
                        want[x, quality._PLACE[b[j], e]] += quality._SIGN[b[j], e]
    assert np.allclose(sums, want) and (counts == n).all()


def test_search_takes_rows_as_they_come(spark):
    long = "ab" * 40
    rows = [(1, "x y " + long, "a"), (1, "x y " + long, "a"), (None, "x z", "b"), (2, None, "c"), (3, "", "d"), (4, long[40:] + "ba" * 20 + " q", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = search.search(docs, docs).collect()
    assert {r["query_id"] for r in got} == {1, None, 4} and len({(r["query_id"], r["rank"]) for r in got}) == len(got)
    # the two rows of one query count once, and both documents of id 1 are found
    of = [(r["doc_id"], round(r["score"], 6)) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 1]
    assert [d for d, _ in of] == [1, 1, None] and of[0][1] == of[1][1] > of[2][1] > 0
    assert not set(search.terms(["a" * 64 + "b" * 64])[0]) & set(search.terms(["b" * 64 + "a" * 64])[0])


def test_pruning_changes_no_result(monkeypatch):
    r = random.Random(6)
    monkeypatch.setattr(search, "BLOCK", 4)
    texts = [" ".join(f"w{int(r.random() ** 3 * 60)}" for _ in range(r.randrange(0, 30))) for _ in range(300)]
    shard = search.Shard(search.packed(list(range(300)), texts), 12.0)
    words, weights = shard.terms[::3].copy(), np.linspace(1, 3, len(shard.terms[::3]))
    everything = {}
    text, t, n = search.counted(texts)
    length = np.bincount(text, n, minlength=300)
    for d, w, c in zip(text, t, n, strict=True):
        if w in words:
            everything[d] = everything.get(d, 0) + weights[list(words).index(w)] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * length[d] / 12.0))
    want = sorted(everything.items(), key=lambda x: (-x[1], x[0]))[:7]
    docs, scores = shard.top(words, weights, 7)
    assert docs.tolist() == [d for d, _ in want] and np.allclose(scores, [s for _, s in want])
    assert len(shard.top(words, weights, 7, want[0][1] * 2)[0]) == 0


def test_a_batch_of_queries_scores_few_documents(monkeypatch):
    """Each query of a batch gets what it gets alone and by brute force; blocks are of documents that are alike, so most are never scored."""
    r = random.Random(3)
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "LEAST_SHARE", 10)
    texts = [" ".join(f"{'abcd'[i % 4]}{int(r.random() ** 2 * 70)}" for _ in range(r.randrange(20, 60))) for i in range(640)]
    texts[601] = texts[40]
    shard = search.Shard(search.packed(list(range(640)), texts), 40.0)
    text, t, n = search.counted(texts)
    length = np.bincount(text, n, minlength=640)
    queries = [(t[text == q], n[text == q] * np.linspace(1, 2, (text == q).sum())) for q in range(0, 640, 20)]
    got = shard.tops(queries, 5, np.zeros(len(queries)))
    for (words, weights), (docs, scores) in zip(queries, got, strict=True):
        weight = dict(zip(words, weights, strict=True))
        all_scores = np.zeros(640)
        for d, w, c in zip(text, t, n, strict=True):
            all_scores[d] += weight.get(w, 0.0) * (c * 2.2 / (c + 1.2 * (0.25 + 0.75 * length[d] / 40.0)))
        want = sorted(range(640), key=lambda d: (-all_scores[d], d))[:5]
        assert docs.tolist() == want and np.allclose(scores, all_scores[want], rtol=1e-12)
        assert docs.tolist() == shard.top(words, weights, 5)[0].tolist()
    # the two equal texts have equal scores to the last bit
    docs, scores = got[2]
    assert docs.tolist()[:2] == [40, 601] and scores[0] == scores[1]
    # documents of other kinds have no common word, and no block mixes kinds but at the edges of clusters
    kinds = np.array([i % 4 for i in shard.order]).reshape(-1, 8)
    assert sum(len(set(k)) > 1 for k in kinds.tolist()) <= search.CLUSTERS


def test_rare_words_in_different_documents_do_not_add_up(monkeypatch):
    """A block's bound is of what rare words give to one of its documents, not of each word's best; a block under the threshold is not scored."""
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "COLUMNS", 1)
    texts = [f"all r{i % 4} s{i}" for i in range(64)]
    shard = search.Shard(search.packed(list(range(64)), texts), 3.0)
    scored = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            scored.append(key)
            return super().__getitem__(key)

    words = np.sort(np.unique(search.terms(["all r0 r1 r2 r3"])[0]))
    docs, scores = shard.top(words, np.ones(5), 64)
    assert len(docs) == 64 and np.ptp(scores) == 0
    shard.dense = shard.dense.view(Watched)
    assert not len(shard.top(words, np.ones(5), 64, scores[0] * 1.2)[0]) and not scored
    assert shard.top(words, np.ones(5), 64, scores[0] * 0.99)[0].tolist() == docs.tolist() and scored


def test_groups_of_queries_share_a_reading_of_the_index(spark, monkeypatch):
    """The index is read twice, for the parts searched ahead and for the others, not twice for each group of queries; results are the same."""
    r = random.Random(5)
    rows = [(i, " ".join(f"w{int(r.random() ** 2 * 90)}" for _ in range(r.randrange(1, 40)))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = sorted(search.search(docs, docs.where("doc_id % 5 = 0")).collect())
    readings, plain = [], search._finder
    monkeypatch.setattr(search, "_finder", lambda *args: readings.append(args) or plain(*args))
    monkeypatch.setattr(search, "QUERY_WORDS", 200)
    monkeypatch.setattr(search, "GROUPS", 8, raising=False)
    assert sorted(search.search(docs, docs.where("doc_id % 5 = 0")).collect()) == one and len(readings) == 2
    assert len(readings[0][0]) > 2
    monkeypatch.setattr(search, "GROUPS", 2)
    assert sorted(search.search(docs, docs.where("doc_id % 5 = 0")).collect()) == one and len(readings) > 4


def test_blocks_side_by_side_are_scored_once(monkeypatch):
    """Blocks beside those that set the first threshold are scored with them, and not again when the others are tried."""
    r = random.Random(8)
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "FIRST_BLOCKS", 3)
    texts = [" ".join(f"w{int(r.random() ** 2 * 40)}" for _ in range(r.randrange(5, 30))) for _ in range(203)]
    shard = search.Shard(search.packed(list(range(203)), texts), 17.0)
    text, t, n = search.counted(texts)
    queries = [(t[text == q], n[text == q].astype(float)) for q in range(0, 203, 7)]
    got = shard.tops(queries, 5, np.zeros(len(queries)))
    monkeypatch.setattr(search, "SIDE", 1)
    monkeypatch.setattr(search, "FIRST_BLOCKS", 10**6)
    want = shard.tops(queries, 5, np.zeros(len(queries)))
    assert all(a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() for a, b in zip(got, want, strict=True))
