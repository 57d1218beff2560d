"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, discard, few_rows, release, slices, token_hashes, written

SHINGLE = 5
SIMILARITY = 0.8
#: Samples of a signature: BANDS x ROWS. A pair at the threshold shares a band but for 1 in 100,000.
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
#: Hash buckets of document frequencies. The floor that collisions put under a frequency is shingles per document over
#: buckets, whatever the number of documents, so weights are alike at every size.
BUCKETS = 1 << 20
#: Rows of the tables of random numbers, and bits that choose a row.
_TABLE_BITS = 14
_CHUNK = 1 << 12
#: Characters of the texts that are cut into shingles at a time, whatever a batch holds; memory is some twenty times that, besides the result.
CUT_CHARS = 1 << 19
#: Parts of a group's elements that meet the group's size apart, so that no task reads the elements of all of a large group.
PARTS = 64
#: Tasks that follow links to components: at least so many, and one for so many links.
LEAST_TASKS, TASK_LINKS = 16, 500_000
#: A pair at the threshold agrees in fewer samples than this but for 1 in 100,000.
LEAST_AGREEING = round(SAMPLES * (SIMILARITY - 4.5 * (SIMILARITY * (1 - SIMILARITY) / SAMPLES) ** 0.5))

_rng = np.random.default_rng(77)
_uniform = lambda: 1.0 - _rng.random((1 << _TABLE_BITS, SAMPLES))
#: r and c are Gamma(2, 1), b is uniform; an element takes each from a row that other bits of its hash choose.
_R = (-np.log(_uniform() * _uniform())).astype(np.float32)
_LOG_C = np.log(-np.log(_uniform() * _uniform())).astype(np.float32)
_B = _uniform().astype(np.float32)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of the texts: index of the text (ascending), 64-bit hash (ascending within it), number of times.

    A text of fewer than SHINGLE words has one shingle of all of them; one without words has none. Texts are cut a few at a time.
    """
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for some in slices(texts, CUT_CHARS):
        text, s, count = _shingles(texts[some])
        parts.append((text + some.start, s, count))
    text, s, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    return text, s, count


def _shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, text = token_hashes(texts, runs=False)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h)
    ends = np.searchsorted(text, text, side="right")
    starts = np.searchsorted(text, text, side="left")
    s = np.zeros(n, np.uint64)
    padded = np.concatenate([h.astype(np.uint64), np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        inside = np.arange(n) + k < ends
        s = s * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, padded[k : k + n] + np.uint64(1), np.uint64(0))
    keep = (np.arange(n) + SHINGLE <= ends) | (np.arange(n) == starts)
    s, text = mix64(s[keep]), text[keep]
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], s[at], np.diff(at, append=len(s))


def frequency_bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def shingle_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket of shingles occurs, over all rows, and the number of documents with a shingle.

    A task adds up its rows in one table and hands it on in chunks, which are added up as they stream by; the driver gets
    one table of BUCKETS numbers.
    """

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, np.int32), 0
        for part in parts:
            texts = list(part.iloc[:, 0])
            for some in slices(texts, CUT_CHARS):
                text, s, _ = shingles(texts[some])
                np.add.at(total, frequency_bucket(s), np.int32(1))
                n += len(np.unique(text))
        made = [(int(i // _CHUNK), total[i : i + _CHUNK].tobytes()) for i in range(0, BUCKETS, _CHUNK) if total[i : i + _CHUNK].any()]
        yield pd.DataFrame([*made, (-1, np.array([n], np.int64).tobytes())], columns=["chunk", "sums"])

    def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for chunk, data in zip(part["chunk"], part["sums"], strict=True):
                more = np.frombuffer(data, np.int64 if chunk < 0 else np.int32)
                sums[chunk] = sums[chunk] + more if chunk in sums else more.astype(np.int64)
        yield pd.DataFrame({"chunk": list(sums), "sums": [x.tobytes() for x in sums.values()]})

    schema = "chunk int, sums binary"
    out, n = np.zeros(BUCKETS, np.int64), 0
    for chunk, data in texts.mapInPandas(counted, schema).repartition(64, "chunk").mapInPandas(added, schema).toLocalIterator():
        if chunk < 0:
            n = int(np.frombuffer(data, np.int64)[0])
        else:
            out[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(data, np.int64)
    return out, n


def inverse_frequencies(frequency: np.ndarray, n: int) -> np.ndarray:
    """Smoothed, scaled inverse document frequencies, from 1 (in every document) to 2 (in hardly any).

    The range is narrow so that a document that differs from thousands of near copies in a few words, which they do not have,
    stays similar to them.
    """
    return (1 + np.log((1 + n) / (1 + frequency)) / np.log(2 + n)).clip(1).astype(np.float32)


def signatures(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """The consistent weighted samples of each text, as 64-bit hashes of shingle and level; all 0 for a text without words."""
    text, s, count = shingles(texts)
    out = np.zeros((len(texts), SAMPLES), np.uint64)
    best = np.full((len(texts), SAMPLES), np.inf, np.float32)
    log_w = np.log(count * idf[frequency_bucket(s)]).astype(np.float32)
    mask = np.uint64((1 << _TABLE_BITS) - 1)
    for at in range(0, len(s), 8192):
        own, doc = s[at : at + 8192], text[at : at + 8192]
        r = _R[(own & mask).astype(np.intp)]
        b = _B[(own >> np.uint64(_TABLE_BITS) & mask).astype(np.intp)]
        level = np.floor(log_w[at : at + 8192, None] / r + b)
        a = _LOG_C[(own >> np.uint64(2 * _TABLE_BITS) & mask).astype(np.intp)] - r * (level - b + 1)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        least = np.minimum.reduceat(a, first, axis=0)
        docs = doc[first]
        better = least < best[docs]
        best[docs] = np.where(better, least, best[docs])
        run = np.repeat(np.arange(len(first)), np.diff(first, append=len(doc)))
        i, k = np.nonzero((a == least[run]) & better[run])
        out[doc[i], k] = mix64(own[i] + level[i, k].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), BANDS)).copy()
    for k in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return out.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of (ascending hashes, weights): sum of minima over sum of maxima."""
    total = float(a[1].sum() + b[1].sum())
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    common = float(np.minimum(a[1][both], b[1][at[both]]).sum())
    return common / (total - common)


def weighted(texts: list[str | None], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    text, s, count = shingles(texts)
    w = count * idf[frequency_bucket(s)].astype(np.float64)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(s[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def fingerprint(text: Column) -> Column:
    """The identity of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): root is the least node of the connected component. Each round, a node takes the least root
    of its neighbours and itself, and then that root's own (which is no greater), until none changes. Each round is written as a
    table, which cuts lineage and tells the planner its real size; the round before goes then."""
    spark = edges.sparkSession
    links = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    # as many tasks as the links need: rounds over few links would else leave many small files
    tasks = max(LEAST_TASKS, links.count() // TASK_LINKS)
    links = links.coalesce(tasks)
    both, pairs = written(links.union(links.select("a", F.col("a").alias("b")).distinct()).coalesce(tasks))
    roots, last = written(both.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").coalesce(tasks))
    while True:
        near = both.join(roots, both["b"] == roots["node"]).select("a", "b", "root").coalesce(tasks)
        near = near.groupBy("a").agg(F.min("root").alias("next"), F.min(F.when(F.col("a") == F.col("b"), F.col("root"))).alias("old")).coalesce(tasks)
        jump = roots.select(F.col("node").alias("next"), "root")
        new, where = written(near.join(jump, "next").select(F.col("a").alias("node"), "old", "root").coalesce(tasks))
        changed = new.where("old != root").limit(1).count()
        roots = new.select("node", "root")
        discard(spark, last)
        last = where
        if not changed:
            discard(spark, pairs)
            return roots


def one_text(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, text) of the wanted (fp, place), each from its first document only, so that copies of a text are dealt to many tasks."""
    return texts.join(wanted.select("fp", "place"), ["fp", "place"], "left_semi").dropDuplicates(["fp", "place"]).select("fp", "text")


def verified(pairs: DataFrame, texts: DataFrame, signs: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Of the pairs (a, b) of fingerprints, those whose texts are similar by the threshold; the signatures rule out most others before the texts are fetched."""

    @F.pandas_udf("boolean")
    def likely(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(z), np.uint16).reshape(-1, SAMPLES) for z in (x, y))
        return pd.Series((a == b).sum(axis=1) >= LEAST_AGREEING)

    def similar(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            known: dict[bytes, str] = {}
            for side in "ab":
                known.update(zip(map(bytes, part[side]), part[f"text_{side}"], strict=True))
            own = dict(zip(known, weighted(list(known.values()), idf), strict=True))
            keep = [similarity(own[bytes(a)], own[bytes(b)]) >= threshold for a, b in zip(part["a"], part["b"], strict=True)]
            yield part.loc[keep, ["a", "b"]]

    left, right = (signs.select(F.col("fp").alias(x), F.col("sign").alias(f"sign_{x}")) for x in "ab")
    some = checkpoint(pairs.join(left, "a").join(right, "b").where(likely("sign_a", "sign_b")).select("a", "b"))
    wanted = some.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    fetched = checkpoint(one_text(texts, wanted.join(signs, "fp")))
    left, right = (fetched.select(F.col("fp").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return some.join(left, "a").join(right, "b").mapInPandas(similar, "a binary, b binary")


def elements(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of the texts as elements that count once: index of the text, element (shingle and how often it came before), weight."""
    text, s, count = shingles(texts)
    before = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    text, s = np.repeat(text, count), np.repeat(s, count)
    return text, mix64(s + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), idf[frequency_bucket(s)].astype(np.float64)


def common_elements(members: DataFrame, idf: np.ndarray) -> DataFrame:
    """(g, common): the elements that over half of a group's texts have, as three packed arrays: elements (ascending), their
    weights, and how many texts miss each. There are at most twice as many as a text of the group has on average."""

    def held(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text, e, w = elements(list(part["text"]), idf)
            own = pd.DataFrame({"g": [*map(bytes, part["g"])], "i": 0}).groupby("g")["i"].ngroup().to_numpy() if len(part) else np.zeros(0, np.int64)
            order = np.lexsort((e, own[text]))
            g, e, w, row = own[text][order], e[order], w[order], text[order]
            at = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (e[1:] != e[:-1])])) if len(e) else np.zeros(0, np.int64)
            yield pd.DataFrame({"g": part["g"].to_numpy()[row[at]], "element": e[at], "w": w[at], "n": np.diff(at, append=len(e))})

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [sorted((x["element"], x["w"], x["missing"]) for x in c) for c in part["c"]]
            data = [b"".join(np.array(z, kind).tobytes() for z, kind in zip(zip(*r, strict=True), ("i8", "f8", "i8"), strict=True)) for r in rows]
            yield pd.DataFrame({"g": part["g"], "common": data})

    part = F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<long>")
    size = members.groupBy("g").agg(F.count(F.lit(1)).alias("size")).select("g", "size", F.explode(part).alias("part"))
    counts = members.select("g", "text").mapInPandas(held, "g binary, element long, w double, n long").groupBy("g", "element").agg(F.sum("n").alias("n"), F.max("w").alias("w"))
    most = counts.withColumn("part", F.pmod("element", F.lit(PARTS))).join(size, ["g", "part"]).where("2 * n > size").groupBy("g").agg(F.collect_list(F.struct("element", "w", (F.col("size") - F.col("n")).alias("missing"))).alias("c"))
    return most.mapInPandas(packed, "g binary, common binary")


def differences(members: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """For each text (fp, g, root): how it differs from what its group has in common.

    excess: the weight of its differences (elements it has beside the common ones, and those it misses) less its share of what
    two similar texts may differ by. diffs: the differences, those it has beside first, then by how rare they are; rest: the weight of
    each difference and those after it.
    """
    share = (1 - threshold) / (1 + threshold)

    def differing(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text, e, w = elements(list(part["text"]), idf)
            cut = np.searchsorted(text, np.arange(len(part) + 1))
            out = []
            for i, data in enumerate(part["common"]):
                own, weight = e[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]
                n = len(data or b"") // 24
                common, common_w, missing = (np.frombuffer(data or b"", kind)[k * n : (k + 1) * n] for k, kind in enumerate(("i8", "f8", "i8")))
                beside, lacks = ~np.isin(own, common), ~np.isin(common, own)
                first = np.lexsort((own[beside], -weight[beside]))
                then = np.lexsort((common[lacks], missing[lacks]))
                diff_w = np.concatenate([weight[beside][first], common_w[lacks][then]])
                rest = np.cumsum(diff_w[::-1])[::-1]
                out.append((float(diff_w.sum() - share * weight.sum()), np.concatenate([own[beside][first], common[lacks][then]]), rest))
            yield part[["fp", "g", "root"]].assign(excess=[x[0] for x in out], diffs=[x[1] for x in out], rest=[x[2] for x in out])

    rows = members.join(common_elements(members, idf), "g", "left").select("fp", "g", "root", "text", "common")
    return checkpoint(rows.mapInPandas(differing, "fp binary, g binary, root binary, excess double, diffs array<long>, rest array<double>"))


def pairs_by_differences(members: DataFrame, idf: np.ndarray, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of texts (fp, text) in groups g and classes root: links that are sure, and pairs (a, b) of different classes to be verified.

    No link between classes within a group is lost, and no row is made for each of a group's pairs. Two texts are similar if and only if
    the weight of what they do not share is at most their shares together. That weight is that of both's differences from
    what the group has in common, less twice the differences they have both. So two texts whose excesses add up to
    no more than 0 are similar, which links all these to the text of least excess; and others need common differences of half
    that sum at least. The first common one in order then leaves that weight to both, so only differences that leave
    enough for the least partner of another class are indexed, and few of them are what many texts lack.
    """
    slack = F.lit(1e-6)
    diffs = differences(members, idf, threshold)
    low = diffs.groupBy("g").agg(F.min("excess").alias("low"), F.min_by("fp", F.struct("excess", "fp")).alias("center"))
    classes = diffs.groupBy("g", "root").agg(F.min("excess").alias("least")).join(low, "g").withColumn("merged", F.col("least") + F.col("low") <= 0)
    other = classes.groupBy("g").agg(F.min(F.when(~F.col("merged"), F.col("least"))).alias("other"))
    classes = checkpoint(classes.join(other, "g").select("g", "root", "low", "center", "merged", F.when(F.col("merged"), F.col("other")).otherwise(F.col("low")).alias("partner")))
    placed = diffs.join(classes, ["g", "root"])
    sure = placed.where("excess + low <= 0 and fp != center").select(F.least("fp", "center").alias("a"), F.greatest("fp", "center").alias("b"))
    placed = placed.where("partner is not null").withColumn("need", F.greatest((F.col("excess") + F.col("partner")) / 2 - slack, slack))
    one = F.when(F.col("merged"), F.col("center")).otherwise(F.col("root"))
    ahead = F.filter(F.arrays_zip("diffs", "rest"), lambda d: d["rest"] >= F.col("need"))
    posts = checkpoint(placed.select("g", "fp", one.alias("one"), "merged", "excess", F.explode(ahead).alias("d")).select("g", "fp", "one", "merged", "excess", "d.diffs", "d.rest"))
    side = lambda x: posts.select("g", "diffs", *[F.col(c).alias(f"{c}_{x}") for c in ("fp", "one", "merged", "excess", "rest")])
    enough = F.least("rest_a", "rest_b") >= (F.col("excess_a") + F.col("excess_b")) / 2 - slack
    apart = F.expr("fp_a < fp_b and not (merged_a and merged_b) and one_a != one_b")
    return sure, side("a").join(side("b"), ["g", "diffs"]).where(apart & enough).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row a document: doc_id, fp (of its text), class_id (the least doc_id of its class), kept (it is that one).

    Texts are near-duplicates if the weighted Jaccard similarity of their shingles, each weighing its count times its
    inverse document frequency, is at least the threshold; classes are the connected components. Equal texts are one node
    from the start, so copies make no pairs. Texts that share a band's key are candidates. In a first round, each is held
    against the least and the greatest text of its bucket only, which joins up large groups with few pairs; after that, texts
    chained by buckets whose classes still differ are searched for all further links between classes by their differences
    from what they have in common (pairs_by_differences), so that no link is lost and no bucket's pairs are enumerated.

    Null and wordless texts count as empty: equal to each other and similar to no other. Ids that are null come last: they
    are kept only if all of their class are null. Rows that repeat an id and its text have the same result. An empty table
    gives an empty result.
    """
    few_rows(docs.sparkSession)
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    frequency, n = shingle_frequencies(texts.select("text"))
    idf = inverse_frequencies(frequency, n)

    @F.pandas_udf("keys array<long>, sign binary")
    def sampled(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = list(part)
            own = [signatures(texts[some], idf) for some in slices(texts, CUT_CHARS)]
            sig = np.concatenate(own) if own else np.zeros((0, SAMPLES), np.uint64)
            worded = sig.any(axis=1)
            keys = [list(k) if w else [] for k, w in zip(band_keys(sig), worded, strict=True)]
            yield pd.DataFrame({"keys": keys, "sign": [x.tobytes() for x in (sig & np.uint64(0xFFFF)).astype(np.uint16)]})

    texts = texts.withColumn("fp", fingerprint(F.col("text")))
    rows = checkpoint(texts.withColumn("s", sampled("text")).select("doc_id", "fp", "s.keys", "s.sign"))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"), F.first("sign").alias("sign")))
    held = nodes.select("fp", F.explode("keys").alias("key"))
    buckets = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1")
    held = checkpoint(held.join(buckets, "key").select("key", "fp", "low", "high"))
    pair = lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = held.select(F.explode(F.array(pair("fp", "low"), pair("fp", "high"))).alias("p")).select("p.a", "p.b").where("a != b").distinct()
    place = lambda c: F.xxhash64(c).alias("place")
    signs, texts = nodes.select("fp", "sign", place("least")), texts.select("fp", "text", place("doc_id"))
    links = checkpoint(verified(stars, texts, signs, idf, threshold))
    release(docs.sparkSession)
    roots = components(links)
    placed = held.select("key", "fp").join(roots, held["fp"] == roots["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    open_keys = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    placed = checkpoint(placed.join(open_keys, "key", "left_semi"))
    chained = placed.join(placed.groupBy("key").agg(F.min("fp").alias("b")), "key").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    groups = components(chained).select(F.col("node").alias("fp"), F.col("root").alias("g"))
    open_texts = placed.select("fp", "root").distinct().join(groups, "fp")
    open_texts = checkpoint(open_texts)
    members = checkpoint(one_text(texts, signs.join(open_texts, "fp")).join(open_texts, "fp"))
    release(docs.sparkSession)
    sure, rest = pairs_by_differences(members, idf, threshold)
    release(docs.sparkSession)
    more = verified(rest.join(stars.select("a", "b"), ["a", "b"], "left_anti"), texts, signs, idf, threshold)
    more = checkpoint(sure.union(more))
    release(docs.sparkSession)
    if more.limit(1).count():
        roots = components(links.union(more))
    classed = nodes.select("fp", "least").join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = classed.groupBy("root").agg(F.min("least").alias("class_id"))
    of = classed.select("fp", "root").join(classes, "root").select("fp", "class_id")
    return rows.select("doc_id", "fp").join(of, "fp").select("doc_id", "fp", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The documents, with their columns, less the near-duplicates of one that stays; of rows that repeat an id and its text, one."""
    # one key for the join and for repeats, so that the whole rows are exchanged once only
    key = F.struct("doc_id", "fp").alias("key")
    kept = near_duplicates(docs, threshold).where("kept").select(key).distinct()
    release(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", fingerprint(F.col("text")).alias("fp")).select("row", key)
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
