"""Changes to a law: reading them, putting siblings together, renumbering, checking, and applying them to its provisions.

A provision is a row (corpus, article, paragraph, inciso, alinea, item, text); an empty part stands for none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, notes
from ..functions.keys import PARTS
from .relational import first_failing
from .sequence import islands

KEY = ["corpus", *PARTS]
# What a command of an amending act does, in order; the first that fits counts.
VERBS = [
    ("rename", r"(?iuU)\brenumerad[oa]s?\b|\bpassa(?:m)?\s+a\s+ser\s+numerad"),
    ("revoke", r"(?iuU)\bfica(?:m)?\s+revogad[oa]s?\b|\brevoga(?:m)?-se\b"),
    ("suppress", r"(?iuU)\bfica(?:m)?\s+suprimid[oa]s?\b"),
    ("add", r"(?iuU)\bacrescid[oa]s?\b|\bacrescenta(?:m)?-se\b|\bfica(?:m)?\s+acrescentad"),
    ("replace", r"(?iuU)\bpassa(?:m)?\s+a\s+vigorar\b|\bseguinte\s+reda[cç][aã]o\b|\bnova\s+reda[cç][aã]o\b"),
]
# Fixed value: where a quotation ends, with the marks of new wordings.
ENDS_QUOTE = r'[”"]\s*(?:\((?:NR|AC|N\.R\.)\))?\s*[.;]?\s*$'
# Fixed value: a change of words: the expression “a” becomes “b”.
WORDS = r'(?iuU)express(?:ão|ões)\s+[“"]([^”"]+)[”"]\s+(?:fica|passa|é|são|ficam|passam)\b.*?[“"]([^”"]+)[”"]'


def key_struct() -> Column:
    return F.struct(*KEY)


def verb(command: Column) -> Column:
    """What a command does: rename, revoke, suppress, add or replace; null for none."""
    return F.coalesce(*(F.when(command.rlike(p), v) for v, p in VERBS))


def word_change(command: Column) -> Column:
    """struct<old, new> of a command that puts one expression for another; null for none."""
    old, new = F.regexp_extract(command, WORDS, 1), F.regexp_extract(command, WORDS, 2)
    return F.when(old != "", F.struct(old.alias("old"), new.alias("new")))


def replace_words(base: DataFrame, swaps: DataFrame, where: list[str]) -> DataFrame:
    """(base's columns, changed): provisions under the key of a change that have its expression get the other one. swaps: where, old, new.

    Several changes of one provision are made in the order of the old expression.
    """
    every = F.array_sort(F.collect_list(F.struct("old", "new")))
    by_key = swaps.groupBy(*where).agg(every.alias("__swaps"))
    out = base.join(by_key, where, "left")
    text = F.aggregate(F.coalesce("__swaps", F.array().cast("array<struct<old:string,new:string>>")), F.col("text"), lambda t, s: F.replace(t, s["old"], s["new"]))
    out = out.withColumn("__new", text)
    return out.select(*[F.col("__new").alias("text") if c == "text" else c for c in base.columns], (~F.col("__new").eqNullSafe(F.col("text"))).alias("changed"))


def commands(lines: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, command, verb, head, body): each command of an act with the quoted lines that follow it, in order.

    A line with a verb outside quotations begins a command; quoted lines belong to the last one. Lines of neither kind end it.
    """
    at = Window.partitionBy(key).orderBy(order)
    opens, closes = F.col(text).rlike("^\\s*[“\"]"), F.col(text).rlike(ENDS_QUOTE)
    rows = lines.withColumns({"__open": opens.cast("int"), "__close": closes.cast("int")})
    so_far = at.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__quoted", (F.col("__open") == 1) | (F.coalesce(F.sum(F.col("__open") - F.col("__close")).over(so_far), F.lit(0)) > 0))
    rows = rows.withColumn("__verb", F.when(~F.col("__quoted"), verb(F.col(text))))
    rows = islands(rows, [key], [order], F.col("__verb").isNotNull() | ~F.col("__quoted"), "command")
    ordered = F.array_sort(F.collect_list(F.when(F.col("__quoted"), F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    body = F.transform(ordered, lambda x: F.regexp_replace(x["t"], rf'^\s*[“"]|{ENDS_QUOTE}', ""))
    found = rows.groupBy(key, "command").agg(F.first("__verb", ignorenulls=True).alias("verb"), F.first(F.when(F.col("__verb").isNotNull(), F.col(text)), ignorenulls=True).alias("head"), body.alias("body"))
    found = found.where(F.col("verb").isNotNull())
    return found.withColumn("command", F.row_number().over(Window.partitionBy(key).orderBy("command")))


def common_prefix(rows: DataFrame, by: list[str]) -> DataFrame:
    """The key that all targets of a group have in common: each part as long as all agree on it and on those before."""
    agreed = rows.groupBy(*by).agg(*(F.when(F.countDistinct(F.coalesce(p, F.lit(""))) == 1, F.first(p)).alias(p) for p in KEY))
    same, out = F.lit(True), []
    for p in KEY:
        same = same & F.col(p).isNotNull()
        out.append(F.when(same, F.col(p)).otherwise("").alias(p))
    return agreed.select(*by, *out)


def merge_siblings(rows: DataFrame, by: list[str], number: str, place: str) -> DataFrame:
    """(by, first, last, n, numbers): runs of numbers that follow each other without a gap. place: the number's place in the order of its level."""
    run = F.col(place) - F.row_number().over(Window.partitionBy(*by).orderBy(place))
    grouped = rows.withColumn("__run", run).groupBy(*by, "__run")
    numbers = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(number).alias("v")))), lambda x: x["v"])
    out = grouped.agg(numbers.alias("numbers"))
    return out.select(*by, F.col("numbers")[0].alias("first"), F.element_at("numbers", -1).alias("last"), F.size("numbers").alias("n"), "numbers")


def with_ids(rows: DataFrame, by: list[str], order: list[str], letter: str = "A", name: str = "id") -> DataFrame:
    """Numbers the changes of an act: A001, A002."""
    return rows.withColumn(name, F.format_string(f"{letter}%03d", F.row_number().over(Window.partitionBy(*by).orderBy(*order))))


def rename_order(old: Column, new: Column) -> list[Column]:
    """Orders renumberings so that none takes a number still in use: those that grow from the last down, then those that shrink from the first up."""
    return [(new <= old).asc(), F.when(new > old, -old).otherwise(old).asc()]


def implied_renumbering(ops: DataFrame, base: DataFrame) -> DataFrame:
    """Renumberings that an act does not say: where § 2º is added to an article that has only a sole paragraph, that becomes § 1º."""
    added = ops.where("action = 'add' and paragraph not in ('', 'UNICO') and coalesce(inciso, '') = ''").select("corpus", "article").distinct()
    said = ops.where("action = 'rename' and paragraph = 'UNICO'").select("corpus", "article")
    sole = base.where("paragraph = 'UNICO' and inciso = '' and alinea = '' and item = ''").select("corpus", "article")
    out = sole.join(added, ["corpus", "article"], "left_semi").join(said, ["corpus", "article"], "left_anti")
    return out.select("corpus", "article", F.lit("UNICO").alias("paragraph"), F.lit("").alias("inciso"), F.lit("").alias("alinea"), F.lit("").alias("item"), F.lit("rename").alias("action"), F.lit("1").alias("new"))


def insertion_place(new: DataFrame, siblings: DataFrame, by: list[str], number: str, at: str) -> DataFrame:
    """(by, number, after, before): where a new provision goes, as the places of its last smaller and first larger sibling.

    One union and one window over numbers in legal order, so no pairs of siblings are made.
    """
    none = F.lit(None).cast(siblings.schema[at].dataType)
    both = siblings.select(*by, number, at).withColumn("__new", F.lit(False)).unionByName(new.select(*by, number).withColumns({at: none, "__new": F.lit(True)}))
    both = both.withColumn("__key", keys.sort_key(F.col(number)))
    order = Window.partitionBy(*by).orderBy("__key", "__new")
    after = F.last(F.col(at), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = F.first(F.col(at), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return both.withColumns({"after": after, "before": before}).where("__new").select(*by, number, "after", "before")


def check(ops: DataFrame, base: DataFrame) -> DataFrame:
    """(ops' columns, status, reason): whether each change can be made to the provisions that there are.

    A target must be there once to be replaced, revoked or renumbered, and must not be there to be added; its parent must be
    there; a wording must not be empty; a period must not end before it begins; a new number must be free, or freed by
    another renumbering of the same plan. Two changes of the same key are for a person to decide.
    """
    there = base.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__there"), F.max(F.upper("text").rlike(r"\bREVOGAD[OA]\b").cast("int")).alias("__gone"))
    out = ops.join(there, KEY, "left")
    lev = keys.level(key_struct())
    above = F.struct("corpus", *(F.when(lev > i, F.col(p)).otherwise("").alias(p) for i, p in enumerate(PARTS)))
    parents = there.select(key_struct().alias("__above"), F.lit(True).alias("__has_parent"))
    out = out.withColumns({"__lev": lev, "__above": above}).join(parents, "__above", "left")
    part_at = lambda k: F.when(lev == k, F.col("new")).otherwise(F.when(lev > k, F.col(PARTS[k])).otherwise(""))
    # what a renumbering makes, and what renumberings free
    made = F.struct("corpus", *(part_at(k).alias(p) for k, p in enumerate(PARTS)))
    taken = there.select(key_struct().alias("__made"), F.lit(True).alias("__taken"))
    freed = ops.where("action = 'rename'").select(key_struct().alias("__made"), F.lit(True).alias("__freed")).distinct()
    out = out.withColumn("__made", made).join(taken, "__made", "left").join(freed, "__made", "left")
    same = F.count(F.lit(1)).over(Window.partitionBy(*KEY))
    acts_on = F.col("action") != "add"
    rules = [
        ("sem artigo", F.coalesce("article", F.lit("")) == ""),
        ("fim antes do início", F.col("until") < F.col("effects")),
        ("texto vazio", F.col("action").isin("add", "replace") & (F.trim(F.coalesce("text", F.lit(""))) == "")),
        ("destino não existe", acts_on & F.col("__there").isNull()),
        ("destino não é único", acts_on & (F.col("__there") > 1)),
        ("já existe", ~acts_on & F.col("__there").isNotNull()),
        ("superior não existe", ~acts_on & (F.col("__lev") > 0) & F.col("__has_parent").isNull()),
        ("já revogado", F.col("action").isin("revoke", "suppress") & (F.col("__gone") == 1)),
        ("número ocupado", (F.col("action") == "rename") & F.col("__taken") & F.col("__freed").isNull()),
        ("conflito", same > 1),
    ]
    reason = first_failing(rules, "")
    ready = F.when(reason == "", "pronto").otherwise("revisar")
    return out.withColumns({"reason": reason, "status": ready}).select(*ops.columns, "status", "reason")


def apply_plan(base: DataFrame, ops: DataFrame) -> DataFrame:
    """(key, text, note): the provisions after the changes of a plan, all checked: replace, revoke, suppress, add and rename.

    Renumbering carries what stands under a provision along. All renumberings are made at once, from the old numbers to the new.
    ops: key, action, text, new, note. A change has its note; other provisions have none.
    """
    plain = ops.where("action in ('replace', 'revoke', 'suppress')").select(*KEY, F.col("action").alias("__action"), F.col("text").alias("__text"), F.col("note").alias("__note"))
    out = base.select(*KEY, "text").join(plain, KEY, "left")
    label = F.concat(F.regexp_extract("text", r"^\s*(Art\.\s*\S+|§\s*\S+|Parágrafo único|[IVXLCDM]+(?:-[A-Z])?\s*[-–]|[a-z]\)|\d[\d.]*\.)", 1), F.lit(" "))
    gone = notes.revoked_line(label, keys.level(key_struct()), F.col("__action") == "suppress")
    wording = F.when(F.col("__action") == "replace", F.col("__text")).when(F.col("__action").isNotNull(), F.trim(gone)).otherwise(F.col("text"))
    out = out.select(*KEY, wording.alias("text"), F.col("__note").alias("note"))
    renames = ops.where("action = 'rename'").select(*KEY, "new", F.col("note").alias("__note")).withColumn("__level", keys.level(key_struct()))
    for k, part in enumerate(PARTS):
        shared = ["corpus", *PARTS[: k + 1]]
        some = renames.where(F.col("__level") == k).select(*shared, F.col("new").alias("__new"), F.col("__note").alias("__renamed"))
        own = reduce(lambda a, b: a & b, [F.col(p) == "" for p in PARTS[k + 1 :]], F.lit(True))
        out = out.join(some, shared, "left").withColumns({"note": F.when(own & F.col("__renamed").isNotNull(), F.col("__renamed")).otherwise(F.col("note")), part: F.coalesce("__new", part)}).drop("__new", "__renamed")
    added = ops.where("action = 'add'").select(*KEY, "text", "note")
    return out.select(*KEY, "text", "note").unionByName(added)


def descendants_of(rows: DataFrame, targets: DataFrame, proper: bool = True) -> DataFrame:
    """(target, rows' columns): the provisions under each target, by one equality join for each level that occurs. targets: target, key."""
    lev = keys.level(key_struct())
    wanted = targets.withColumn("__level", lev)
    out = None
    for k in range(-1, len(PARTS) - 1 + (not proper)):
        shared = ["corpus", *PARTS[: k + 1]]
        some = wanted.where(F.col("__level") == k).select("target", *shared)
        hit = rows.join(some, shared).where(lev > k if proper else lev >= k)
        hit = hit.select("target", *rows.columns)
        out = hit if out is None else out.unionByName(hit)
    return out


def self_citations(mentions: DataFrame, acts: DataFrame, by: list[str]) -> DataFrame:
    """Mentions less those of the act itself: same kind and number, and year and sphere equal or not said by one side. A left anti join."""
    agrees = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit("")).isin("") | F.coalesce(F.col(f"a.{c}"), F.lit("")).isin("") | (F.col(f"m.{c}") == F.col(f"a.{c}"))
    on = reduce(lambda a, b: a & b, [F.col(f"m.{c}") == F.col(f"a.{c}") for c in [*by, "kind", "number"]])
    return mentions.alias("m").join(acts.alias("a"), on & agrees("year") & agrees("sphere"), "left_anti")
