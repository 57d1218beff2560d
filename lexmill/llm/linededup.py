"""Line dedup by a segment-partition edit join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, written

#: Edits (of code points) within which a line of MIN_CHARS code points or more repeats another such; shorter lines repeat only equal ones.
EDITS = 2
MIN_CHARS = 24
#: Up to so many lines (8 bytes each), those that candidate pairs name are sent to all tasks; more of them are joined by a shuffle.
BROADCAST_LINES = 500_000
#: Lines that make up more than one in so many of all lines are keyed apart, once; there are fewer of them than this.
OFTEN = 1000
#: Frequent letters, which a line's sketch counts modulo 64.
COUNTED = "eantirsohd"


def documents(docs: DataFrame) -> DataFrame:
    """doc (null flag, doc_id, hash of the text) and body. Null counts as empty. The hash is made here, once a document, and not again for each line."""
    text = F.coalesce("text", F.lit(""))
    doc = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("text"))
    return docs.select(doc.alias("doc"), text.alias("body"))


def document_lines(docs: DataFrame) -> DataFrame:
    """One row a line: doc, pos, line."""
    return documents(docs).select("doc", F.posexplode(F.split("body", "\n")).alias("pos", "line"))


def eligible(line: Column) -> Column:
    """Whether a line takes part: of any length, but not blank."""
    return line.rlike(WORD)


def identity(line: Column) -> list[Column]:
    """127 bits by which equal lines are known; the first 63, with a last bit of 0, are the line's name in the join."""
    return [F.xxhash64(line).bitwiseAND(F.lit(-2)).alias("h"), F.xxhash64(F.lit(1), line).alias("h2")]


def probes(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """What a line looks up: how much shorter the other line is, the number of the other's segment, and how far that has moved here.

    A line within `edits` edits and not longer than the probing one leaves at least one of its edits + 1 segments unchanged,
    which the probing line has at a place shifted by few characters: for segment i, by no more than the edits before it and
    those after it allow. Where nothing is shorter or moved, it is the line's own segment, under which it is found.
    """
    return [
        (less, i, shift)
        for less in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)
    ]


def segment_keys(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(h, n, line) to (key, mark): a row for each key that a line probes. mark is h, and one more where the line is in the index under that key too.

    A key is made of the length of the line that is looked for, the number of its segment and the segment. Segments are of
    nearly equal length, longer ones last. One literal array is exploded and each key computed by the same short expression,
    which stays small enough to be compiled to machine code. Segments are cut from two bytes for each character, without
    counting characters from the line's start for each; only lines with characters beyond that are cut as text.
    """
    shape = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in probes(edits))))
    rows = lines.withColumn("bytes", F.encode("line", "UTF-16BE")).withColumn("bytes", F.expr("if(octet_length(bytes) = 2 * n, bytes, null)"))
    rows = rows.select("h", "n", "line", "bytes", shape.alias("p"))
    parts = edits + 1
    base, longer = f"int((n - p.d) div {parts})", f"({parts} - (n - p.d) % {parts})"
    place, size = f"({base} * p.i + greatest(0, p.i - {longer}) + 1 + p.s)", f"({base} + int(p.i >= {longer}))"
    rows = rows.where(f"{place} >= 1 and {place} + {size} - 1 <= n")
    segment = f"coalesce(substr(bytes, 2 * {place} - 1, 2 * {size}), encode(substr(line, {place}, {size}), 'UTF-16BE'))"
    return rows.select(F.expr(f"xxhash64(n - p.d, p.i, {segment})").alias("key"), F.expr("h + int(p.d = 0 and p.s = 0)").alias("mark"))


def letter_sketch(line: Column) -> Column:
    """How often each of a few letters occurs, modulo 64, in one long."""
    count = lambda c: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
    return sum((F.call_function("shiftleft", count(c).cast("long").bitwiseAND(F.lit(63)), F.lit(6 * i)) for i, c in enumerate(COUNTED)), F.lit(0).cast("long"))


def sketches_near(a: Column, b: Column, edits: int) -> Column:
    """Whether two sketches may be those of lines within `edits` edits: an edit changes two counts by one at most."""
    part = lambda x, i: F.call_function("shiftright", x, F.lit(6 * i)).bitwiseAND(F.lit(63))
    apart = lambda i: F.abs(part(a, i) - part(b, i))
    return sum((F.least(apart(i), F.lit(64) - apart(i)) for i in range(len(COUNTED))), F.lit(0)) <= 2 * edits


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _common(a: Column, b: Column, most: Column) -> Column:
    """Length of the common prefix of two strings, up to `most`: parts of halving length are compared, from 2^30 down to 1."""
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda acc, s: F.when((s <= most - acc) & (a.substr(acc + 1, s) == b.substr(acc + 1, s)), acc + s).otherwise(acc))


def within_edits(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether two strings of more than 2 x edits characters are within `edits` edits: a banded bit-parallel edit distance.

    What both begin and end with is cut off but for a few characters, which changes no distance. The edit table has a row
    for each character of the longer string b and a column for each of a. Of each column, only the 2 x edits + 1 rows around
    the diagonal are kept, as two bit vectors: where the distance goes up from row to row, and where down. The next column's
    vectors follow from these and from which rows match by a few operations on whole vectors. The distance is followed down
    the band's lower edge and, from where that meets the last row, along it; a column beyond the limit ends the work.
    """
    width, spare = 2 * edits + 1, edits + 2
    mask = F.lit((1 << width) - 1)
    shift = lambda x, k: F.call_function("shiftright", x, k if isinstance(k, Column) else F.lit(k))

    def distance(cut: Column) -> Column:
        rest = lambda x: F.split(x.substr(cut["ahead"] + 1, F.length(x) - cut["ahead"] - cut["behind"]), "")
        return _let(F.struct(rest(b).alias("rows"), rest(a).alias("columns")), table)

    def table(t: Column) -> Column:
        rows, columns, m, n = t["rows"], t["columns"], F.size(t["rows"]), F.size(t["columns"])

        def step(s: Column, j: Column) -> Column:
            up, down, score = s["up"], s["down"], s["score"]
            matches = F.lit(0)
            for p in range(width):
                row = j + (p - edits)
                matches = matches + F.when(F.get(rows, F.greatest(row, F.lit(0))) == F.get(columns, j), F.when(row >= 0, 1 << p).otherwise(0)).otherwise(0)

            def next_column(v: Column) -> Column:
                """v: the matches and where the distance stays the same along the diagonal; then the horizontal differences."""
                d = v["d"]
                plus = down.bitwiseOR(mask - d.bitwiseOR(up))
                return _let(F.struct(d.alias("d"), plus.alias("plus"), d.bitwiseAND(up).alias("minus")), differences)

            def differences(h: Column) -> Column:
                tilted = shift(h["d"], 1)
                place = F.least(F.greatest(m - 1 - j + edits, F.lit(0)), F.lit(width - 1))
                edge = F.when(shift(h["d"], 2 * edits) == 0, 1).otherwise(0)
                along = shift(h["plus"], place).bitwiseAND(F.lit(1)) - shift(h["minus"], place).bitwiseAND(F.lit(1))
                return F.struct(
                    h["minus"].bitwiseOR(mask - tilted.bitwiseOR(h["plus"])).alias("up"),
                    tilted.bitwiseAND(h["plus"]).alias("down"),
                    (score + F.when(j < m - edits, edge).otherwise(along)).alias("score"),
                )

            same = lambda x: (x.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(x).bitwiseOR(down).bitwiseAND(mask)
            moved = _let(matches, lambda x: _let(F.struct(same(x).alias("d")), next_column))
            return F.when(score > n - m + 2 * edits, s).otherwise(moved)

        first = F.struct(F.lit(((1 << width) - 1) ^ ((1 << edits) - 1)).alias("up"), F.lit(0).alias("down"), F.lit(edits).alias("score"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), first, step)["score"] <= edits

    ahead = _common(a, b, F.length(a))
    behind = lambda c: _common(F.reverse(a), F.reverse(b), F.length(a) - c)
    spared = lambda c: F.greatest(F.lit(0), c - spare)
    return _let(ahead, lambda c: _let(F.struct(spared(c).alias("ahead"), spared(behind(c)).alias("behind")), distance))


def near_pairs(lines: DataFrame, often: DataFrame, edits: int = EDITS) -> DataFrame:
    """Pairs of different lines within `edits` edits, each once: (a, h2_a, first_a, b, h2_b, first_b).

    lines: (at, h, h2, n, line) of all lines that take part. often: (h, only), of lines that stand very often, the place where they are keyed.
    Keys that only one line has go right after the one exchange of the keys; what is left is small. Texts and letter counts
    are fetched only for the lines that are left.
    """
    spark = lines.sparkSession
    keyed = lines.join(F.broadcast(often), "h", "left").where(F.col("only").isNull() | F.col("at").eqNullSafe(F.col("only"))).select("h", "n", "line")
    same = Window.partitionBy("key")
    keys = segment_keys(keyed, edits).withColumns({"__low": F.min("mark").over(same), "__high": F.max("mark").over(same)})
    shared = keys.where("(__low & -2) != (__high & -2)").select("key", F.expr("mark & -2").alias("h"), F.expr("mark & 1 = 1").alias("own"))
    shared = checkpoint(shared)
    named = checkpoint(shared.select("h").distinct())
    some = lines.join(F.broadcast(named) if named.count() <= BROADCAST_LINES else named, "h", "left_semi")
    texts = some.groupBy("h", "h2").agg(F.min("at").alias("first"), F.first("n").alias("n"), F.first("line").alias("line"))
    texts = checkpoint(texts.withColumn("sketch", letter_sketch(F.col("line"))))
    shared = shared.distinct().join(texts.select("h", "n", "sketch"), "h")
    side = lambda x: shared.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("h", "n", "sketch", "own")))
    fits = F.expr(f"h_a != h_b and n_b - n_a between 0 and {edits} and (n_a < n_b or h_a < h_b)") & sketches_near(F.col("sketch_a"), F.col("sketch_b"), edits)
    pairs = checkpoint(side("a").where("own_a").join(side("b"), "key").where(fits).select(F.col("h_a").alias("a"), F.col("h_b").alias("b")).distinct())
    of = lambda x: texts.select(F.col("h").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("line", "first", "h2")))
    # few bytes but much work a pair: dealt out evenly, which a join that merges small partitions would not do
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = pairs.join(of("a"), "a").join(of("b"), "b").repartition(spread).where(within_edits(F.col("line_a"), F.col("line_b"), edits))
    return out.select("a", "h2_a", "first_a", "b", "h2_b", "first_b")


def line_classes(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """A row for each different line that is not blank: first (doc, pos) where it stands first, n (its code points), times,
    links (how many other lines are within `edits` edits) and stays (false if such a line stands before its first place).

    Lines are in order of doc_id (null last), hash of the text, and position. Lines of fewer than MIN_CHARS code points have
    no links. Texts of lines are not dealt out, only their hashes are.
    """
    lines = document_lines(docs).where(eligible(F.col("line")))
    lines = lines.select(F.struct("doc", "pos").alias("at"), "line", F.length("line").alias("n"), *identity(F.col("line")))
    classes, where = written(lines.groupBy("h", "h2").agg(F.min("at").alias("first"), F.min("n").alias("n"), F.count(F.lit(1)).alias("times")))
    total = classes.agg(F.sum("times")).first()[0] or 0
    often = classes.where((F.col("times") > total / OFTEN) & (F.col("n") >= MIN_CHARS)).select("h", F.col("first").alias("only"))
    pairs = near_pairs(lines.where(F.col("n") >= MIN_CHARS), often, edits)
    later = F.col("first_a") > F.col("first_b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("h"), F.col("h2_a").alias("h2"), later.alias("later")), F.struct(F.col("b").alias("h"), F.col("h2_b").alias("h2"), (~later).alias("later"))))
    linked = checkpoint(pairs.select(ends.alias("x")).groupBy("x.h", "x.h2").agg(F.count(F.lit(1)).alias("links"), F.max("x.later").alias("later")))
    out = classes.join(F.broadcast(linked) if linked.count() <= BROADCAST_LINES else linked, ["h", "h2"], "left")
    return out.select("first", "n", "times", F.coalesce("links", F.lit(0)).alias("links"), (~F.coalesce("later", F.lit(False))).alias("stays"))


def line_counts(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """One row a document: doc_id, n_lines (null text: one empty line), n_removed, chars_removed, n_links.

    A line is removed if an equal line stands before it, or if it has MIN_CHARS code points and another such line within
    `edits` edits occurs anywhere before it first does. n_links counts, for the lines that stand first in the document, their
    repeats and the other lines near them, so that a document is seen to share lines also if it has them first. Rows that
    repeat an id and its text are one document and have the same result; null ids come last in the order. Blank lines stay.
    An empty table gives an empty result.
    """
    filled = eligible(F.col("line"))
    # a document given k times has k first lines
    total = document_lines(docs).groupBy("doc").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(filled).alias("n"), F.coalesce(F.sum(F.when(filled, F.length("line"))), F.lit(0)).alias("chars"), F.count_if(F.col("pos") == 0).alias("same")
    )
    total = total.select("doc", *(F.expr(f"{c} div same").alias(c) for c in ("rows", "n", "chars")), F.explode(F.expr("sequence(1, int(same))")))
    # a document given again adds to `times` of its lines, but it is no other document
    by = line_classes(docs, edits).groupBy("first.doc").agg(
        F.count_if("stays").alias("kept"), F.sum(F.when(F.col("stays"), F.col("n"))).alias("kept_chars"), F.sum(F.col("times") - 1 + F.col("links")).alias("links")
    )
    of = lambda c: F.coalesce(c, F.lit(0))
    return total.join(by, total["doc"].eqNullSafe(by["doc"]), "left").select(
        total["doc"]["id"].alias("doc_id"), F.col("rows").alias("n_lines"), (F.col("n") - of("kept")).cast("long").alias("n_removed"), (F.col("chars") - of("kept_chars")).cast("long").alias("chars_removed"), of("links").cast("long").alias("n_links")
    )


def without_repeated_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """The documents, with their columns, less the lines that repeat; n_chars, where it is a column, follows the text.

    Documents left without a word go, as do null, empty and blank texts. Rows that repeat an id and its text are one
    document, so both stay. An empty table gives an empty result.
    """
    kept = line_classes(docs, edits).where("stays").groupBy("first.doc").agg(F.collect_set("first.pos").alias("kept"))
    body = F.coalesce("text", F.lit(""))
    doc = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(body).alias("text"))
    rows = docs.select(F.struct("*").alias("row"), doc.alias("key"), body.alias("body"))
    rows = rows.join(kept, rows["key"].eqNullSafe(kept["doc"]), "left")
    stays = lambda line, i: ~eligible(line) | F.coalesce(F.array_contains("kept", i), F.lit(False))
    rows = rows.withColumn("body", F.array_join(F.filter(F.split("body", "\n"), stays), "\n")).where(F.col("body").rlike(WORD))
    changed = {"text": F.col("body"), "n_chars": F.length("body").cast("long")}
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


#: What line_counts gives, for another engine: every line against every earlier one of nearly its length. levenshtein counts bytes
#: there, and an edit of a character is up to 4 of them. So pairs within 4 x EDITS bytes are compared again with each character
#: beyond ASCII replaced by a sign of ASCII that neither line has, for which there are enough in lines of fewer than 30 such characters.
SQL = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), firsts as (
  select line, length(line) as n, count(*) as times, min({{'d': doc_id, 'p': pos}}) as first from lines where regexp_matches(line, '{WORD}') group by line
), near as (
  select a.line as a, b.line as b, a.first as first_a, b.first as first_b,
    array_to_string(list_distinct(regexp_extract_all(a.line || b.line, '[^\\x00-\\x7f]')), '') as signs,
    array_to_string(list_filter(list_transform(range(1, 127), lambda x: chr(x::int)), lambda x: not contains(a.line || b.line, x)), '') as free
  from firsts a join firsts b on b.n between a.n - {EDITS} and a.n + {EDITS} and a.first < b.first and a.n >= {MIN_CHARS} and b.n >= {MIN_CHARS} and levenshtein(a.line, b.line) <= {4 * EDITS}
), pairs as (
  select * from near where levenshtein(translate(a, signs, free[1:length(signs)]), translate(b, signs, free[1:length(signs)])) <= {EDITS}
), links as (
  select line, count(*) as k from (select a as line from pairs union all select b from pairs) group by line
), kept as (
  select first.d as doc_id, count(*) filter (line not in (select b from pairs)) as k, coalesce(sum(n) filter (line not in (select b from pairs)), 0) as c, sum(times - 1 + coalesce(links.k, 0)) as l
  from firsts left join links using (line) group by 1
), totals as (
  select doc_id, count(*) as n_lines, count(*) filter (regexp_matches(line, '{WORD}')) as n, coalesce(sum(length(line)) filter (regexp_matches(line, '{WORD}')), 0) as c from lines group by doc_id
)
select t.doc_id, t.n_lines::bigint as n_lines, (t.n - coalesce(k.k, 0))::bigint as n_removed, (t.c - coalesce(k.c, 0))::bigint as chars_removed, coalesce(k.l, 0)::bigint as n_links
from totals t left join kept k on t.doc_id = k.doc_id
"""
