"""Column functions that write notes, descriptions and names of provisions and acts. A key is a struct of corpus and keys.PARTS."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import brazilian
from .keys import PARTS, level
from .text import norm, ordinal, roman_value

# Fixed value: acts whose names are masculine.
MASCULINE = (
    r"(?iu)^(?:Decreto|Dec\.|DL\b|Ato\b|Ajuste|Conv[eê]nio|Protocolo|Parecer|Despacho|Regulamento|Regimento|Provimento|Comunicado|Ac[oó]rd[aã]o|C[oó]digo|Edital|Termo|Aviso|Of[ií]cio|ADCT\b)"
)
# Fixed value: an act's number and its year.
NUMBER_YEAR = r"^(.*?\b\d[\d.]*/)(\d{4}|\d{2})\b(.*)$"
# Names of units in the plural, by level.
PLURALS = ["arts.", "§§", "incisos", "alíneas", "itens"]


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def by_act(citation: Column) -> Column:
    return F.when(F.trim(citation).rlike(MASCULINE), "pelo").otherwise("pela")


def of_act(citation: Column) -> Column:
    return F.when(F.trim(citation).rlike(MASCULINE), "do").otherwise("da")


def corpus_name(corpus: Column) -> Column:
    return F.when(corpus == "ADCT", corpus).otherwise(F.regexp_replace(F.initcap(corpus), "Unico", "Único"))


def format_citation(citation: Column, digits: int = 4, pivot: int = 70) -> Column:
    """The year of the first number/year with two or four digits; two-digit years below the pivot are of this century."""
    part = lambda i: F.regexp_extract(F.trim(citation), NUMBER_YEAR, i)
    year = part(2)
    long = F.when(F.length(year) == 2, F.concat(F.when(year.cast("int") < pivot, "20").otherwise("19"), year)).otherwise(year)
    return F.when(year == "", F.trim(citation)).otherwise(F.concat(part(1), F.right(long, F.lit(digits)), part(3)))


def effects_text(effects: Column, until: Column, digits: int = 4) -> Column:
    """What a note says of the time: nothing, from a day on, or from a day to a day."""
    return (
        F.when(effects.isNull(), ".")
        .when(until.isNotNull(), F.concat(F.lit(", efeitos de "), brazilian(effects, digits), F.lit(" a "), brazilian(until, digits), F.lit(".")))
        .otherwise(F.concat(F.lit(", efeitos a partir de "), brazilian(effects, digits), F.lit(".")))
    )


def fallback_note(original: Column, effects: Column, digits: int = 4) -> Column:
    """The note over a wording that had none, when it is replaced."""
    head = F.when(original, "Redação original").otherwise("Redação anterior")
    return F.concat(head, F.when(effects.isNull(), ".").otherwise(F.concat(F.lit(", efeitos até "), brazilian(F.date_sub(effects, 1), digits), F.lit("."))))


def paragraph_name(number: Column) -> Column:
    return F.when(number == "UNICO", "parágrafo único").otherwise(F.concat(F.lit("§ "), ordinal(number)))


def description(key: Column, suffix: bool = True) -> Column:
    """A provision from its smallest part up: alínea “a” do inciso II do § 1º do art. 5º."""
    has = lambda p: F.coalesce(key[p], F.lit("")) != ""
    out = F.concat(F.lit("art. "), ordinal(key["article"]))
    out = F.concat(F.when(has("paragraph"), F.concat(paragraph_name(key["paragraph"]), F.lit(" do "))).otherwise(""), out)
    out = F.concat(F.when(has("inciso"), F.concat(F.lit("inciso "), key["inciso"], F.lit(" do "))).otherwise(""), out)
    out = F.concat(F.when(has("alinea"), F.concat(F.lit("alínea “"), key["alinea"], F.lit("” do "))).otherwise(""), out)
    out = F.concat(F.when(has("item"), F.concat(F.lit("item "), key["item"], F.lit(" da "))).otherwise(""), out)
    return F.concat(out, F.when(key["corpus"] != "PRINCIPAL", F.concat(F.lit(" do "), corpus_name(key["corpus"]))).otherwise("")) if suffix else out


def key_label(key: Column) -> Column:
    """A key as it is listed: art. 5 / § 1 / inciso II."""
    named = [("article", "art. "), ("paragraph", "§ "), ("inciso", "inciso "), ("alinea", "alínea "), ("item", "item ")]
    parts = [F.when(F.coalesce(key[p], F.lit("")) != "", F.when(key[p] == "UNICO", "parágrafo único").otherwise(F.concat(F.lit(n), key[p]))) for p, n in named]
    return F.concat_ws(" / ", *parts)


def parse_key(text: Column, corpus: str = "PRINCIPAL") -> Column:
    """The key that a person wrote, such as art. 2 / § 1 / inciso II; null without an article."""
    plain = F.regexp_replace(F.regexp_replace(text, "[º°]", ""), "–", "-")
    said = norm(plain)
    found = lambda x, p: F.upper(F.regexp_replace(F.regexp_extract(x, p, 1), r"\s", ""))
    article = found(said, r"\barts?\.?\s*(\d+(?:\s*-\s*[a-z]+)?)")
    paragraph = F.when(said.contains("paragrafo unico"), "UNICO").otherwise(found(plain, r"(?i)§§?\s*(\d+(?:\s*-\s*[a-z]+)?)"))
    made = F.struct(
        F.lit(corpus).alias("corpus"), article.alias("article"), paragraph.alias("paragraph"), found(said, r"\bincisos?\s+([ivxlcdm]+(?:-[a-z]+)?)\b").alias("inciso"),
        F.regexp_extract(said, r"\balineas?\s+[\"'“”‘’]?([a-z])\b", 1).alias("alinea"), F.regexp_extract(said, r"\bite(?:m|ns)\s+(\d+(?:\.\d+)*)", 1).alias("item"),
    )
    return F.when(article != "", made)


def consecutive(values: Column, lev: Column) -> Column:
    """Whether numbers of a level follow each other without a gap: 3, 4, 5; IV, V; a, b; 39-A, 39-B."""
    head, tail = (lambda v: F.regexp_extract(v, "^([^-]*)", 1)), (lambda v: F.regexp_extract(v, "-(.*)$", 1))
    place = lambda v: F.when(lev == 2, roman_value(head(v))).when(lev == 3, F.ascii(v)).otherwise(F.when(head(v).rlike(r"^\d{1,9}$"), head(v).cast("int")))
    steps = F.when(F.size(values) > 1, F.sequence(F.lit(1), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    by_one = lambda f: F.forall(steps, lambda i: F.coalesce(f(values[i]) - f(values[i - 1]) == 1, F.lit(False)))
    plain = F.forall(values, lambda v: tail(v) == "") & by_one(place)
    letters = F.forall(values, lambda v: (place(v) == place(values[0])) & (F.length(tail(v)) == 1)) & by_one(lambda v: F.ascii(tail(v)))
    return F.forall(values, lambda v: place(v).isNotNull()) & (plain | letters)


def enumerated(values: Column, lev: Column) -> Column:
    """Numbers of siblings in a sentence: 23 a 30 for three or more without a gap, else with commas and a last e."""
    shown = F.transform(values, lambda v: F.when(lev == 3, F.concat(F.lit("“"), v, F.lit("”"))).when(lev < 2, ordinal(v)).otherwise(v))
    return (
        F.when(F.size(values) == 1, shown[0])
        .when((F.size(values) >= 3) & consecutive(values, lev), F.concat(shown[0], F.lit(" a "), F.element_at(shown, -1)))
        .otherwise(F.concat(F.array_join(F.slice(shown, F.lit(1), F.greatest(F.size(shown) - 1, F.lit(0))), ", "), F.lit(" e "), F.element_at(shown, -1)))
    )


def group_description(key: Column, values: Column, verb: Column) -> Column:
    """Siblings and where they stand. key is that of the first; values are the numbers of all at its level. What is added stands "ao" or "à"."""
    lev = level(key)
    above = F.struct(key["corpus"].alias("corpus"), *(F.when(lev > i, key[p]).otherwise("").alias(p) for i, p in enumerate(PARTS)))
    names = F.element_at(F.array(*map(F.lit, PLURALS)), lev + 1)
    joint = F.when(level(above) == 3, " da ").otherwise(" do ")
    many = F.concat(names, F.lit(" "), enumerated(values, lev), F.when(lev > 0, F.concat(joint, description(above))).otherwise(F.when(key["corpus"] != "PRINCIPAL", F.concat(F.lit(" do "), corpus_name(key["corpus"]))).otherwise("")))
    said = F.when(F.size(values) > 1, many).otherwise(description(key))
    into = F.when(said.rlike("^(?:(?! do ).)* da "), F.regexp_replace(said, "^(.*?) da ", "$1 à ")).otherwise(F.regexp_replace(said, "^(.*?) do ", "$1 ao "))
    at_top = F.regexp_replace(said, " do (ADCT|[^ ]+)$", " ao $1")
    return F.when(verb != "add", said).when(lev > 0, into).when(key["corpus"] != "PRINCIPAL", at_top).otherwise(said)


def opening(verb: Column, lev: Column, plural: Column) -> Column:
    """How a note begins: Acrescidos os, Revogada a, Redação dada ao."""
    end = F.concat(F.when(lev == 3, "a").otherwise("o"), F.when(plural, "s").otherwise(""))
    done = F.concat(F.when(verb == "add", "Acrescid").when(verb == "suppress", "Suprimid").otherwise("Revogad"), end, F.lit(" "), end, F.lit(" "))
    given = F.when(lev == 3, F.when(plural, "às ").otherwise("à ")).otherwise(F.when(plural, "aos ").otherwise("ao "))
    return F.when(verb == "replace", F.concat(F.lit("Redação dada "), given)).otherwise(done)


def new_note(verb: Column, key: Column, values: Column, citation: Column, effects: Column, until: Column, digits: int = 4, via: Column | None = None) -> Column:
    """The note of a change: add, replace, revoke or suppress. via: the act whose wording the citing act changes."""
    cite = format_citation(citation, digits)
    by = F.concat(F.lit(" "), by_act(cite), F.lit(" "), cite)
    if via is not None:
        changed = F.when(by_act(via) == "pelo", "alterado").otherwise("alterada")
        by = F.when(via.isNull(), by).otherwise(F.concat(F.lit(" "), by_act(via), F.lit(" "), format_citation(via, digits), F.lit(", "), changed, by))
    return F.concat(opening(verb, level(key), F.size(values) > 1), group_description(key, values, verb), by, effects_text(effects, until, digits))


def rename_note(key: Column, new: Column, citation: Column, effects: Column, until: Column, digits: int = 4) -> Column:
    """The note of a new number for a paragraph, inciso, alínea or item."""
    lev = level(key)
    above = F.struct(key["corpus"].alias("corpus"), *(F.when(lev > i, key[p]).otherwise("").alias(p) for i, p in enumerate(PARTS)))
    old = F.element_at(F.array(*(F.coalesce(key[p], F.lit("")) for p in PARTS)), lev + 1)
    unit = F.element_at(F.array(*map(F.lit, ("", "", "inciso ", "alínea ", "item "))), lev + 1)
    shown = lambda v: F.when(lev == 3, F.concat(F.lit("“"), v, F.lit("”"))).otherwise(v)
    small = F.concat(F.when(lev == 3, "Renumerada a ").otherwise("Renumerado o "), unit, shown(old), F.lit(" para "), unit, shown(new), F.when(level(above) == 3, " da ").otherwise(" do "), description(above))
    large = F.concat(F.lit("Renumerado o "), paragraph_name(old), F.lit(" para § "), ordinal(new), F.lit(" do "), description(above))
    cite = format_citation(citation, digits)
    return F.concat(F.when(lev == 1, large).otherwise(small), F.lit(" "), by_act(cite), F.lit(" "), cite, effects_text(effects, until, digits))


def new_label(lev: Column, number: Column) -> Column:
    """The label of a provision that gets another number: '§ 3º ', '§ 10. ', 'VIII - ', 'd) ', '2. '."""
    head = F.regexp_extract(number, r"^(\d+)", 1)
    small = (head != "") & (head.cast("int") <= 9)
    paragraph = F.concat(F.lit("§ "), F.when(small, ordinal(number)).otherwise(F.concat(number, F.lit("."))), F.lit(" "))
    return F.when(lev == 1, paragraph).when(lev == 2, F.concat(number, F.lit(" - "))).when(lev == 3, F.concat(number, F.lit(") "))).otherwise(F.concat(number, F.lit(". ")))


def revoked_line(label: Column, lev: Column, suppressed: Column) -> Column:
    return F.concat(F.rtrim(label), F.when(suppressed, " SUPRIMID").otherwise(" REVOGAD"), F.when(lev == 3, "A").otherwise("O"))


def minimal_edit(old: Column, new: Column) -> Column:
    """struct<start, removed, added>: the least stretch of the old text whose replacement gives the new one."""
    steps = F.array(*(F.lit(1 << k) for k in range(20, -1, -1)))

    def common(a: Column, b: Column, most: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda n, s: F.when((s <= most - n) & (a.substr(n + 1, s) == b.substr(n + 1, s)), n + s).otherwise(n))

    least = F.least(F.length(old), F.length(new))

    def parts(ahead: Column) -> Column:
        behind = common(F.reverse(old), F.reverse(new), least - ahead)
        return _let(behind, lambda n: F.struct(ahead.alias("start"), old.substr(ahead + 1, F.length(old) - ahead - n).alias("removed"), new.substr(ahead + 1, F.length(new) - ahead - n).alias("added")))

    return _let(common(old, new, least), parts)


def comparable(text: Column) -> Column:
    """For comparing wordings: only white space is made alike."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def preview(text: Column, most: int = 170) -> Column:
    """The beginning of a text, cut between words, with an ellipsis where something is left out."""
    said = comparable(text)
    cut = F.regexp_replace(said.substr(1, most), r"\s+\S*$", "")
    return F.when(F.length(said) <= most, said).otherwise(F.concat(cut, F.lit("…")))


def identify(text: Column) -> Column:
    """Which law a text is: CONSTITUICAO_FEDERAL, CONSTITUICAO_ESTADUAL, or KIND:number; empty for others."""
    said = norm(text)
    head = said.substr(1, 160)
    p = r"\b(lei\s+complementar|lei|decreto(?:\s+legislativo)?|portaria(?:\s+conjunta)?|instrucao\s+normativa|resolucao|emenda\s+constitucional)\s*(?:n\s*[o.]?\s*)?(\d[\d.]*)"
    kind, number = F.regexp_extract(said, p, 1), F.regexp_replace(F.regexp_extract(said, p, 2), r"\.", "")
    named = head.contains("constituicao")
    return (
        F.when(named & head.rlike(r"\b(?:federativa|republica|federal)\b"), "CONSTITUICAO_FEDERAL")
        .when(named & head.rlike(r"\bestadual\b|\bestado do para\b|\bdo para\b"), "CONSTITUICAO_ESTADUAL")
        .when(number != "", F.concat(F.regexp_replace(F.upper(kind), r"\s", "_"), F.lit(":"), number))
        .otherwise("")
    )


def sphere(text: Column) -> Column:
    """The sphere that a citation names: FEDERAL, CGIBS or ESTADUAL; empty for none."""
    said = F.upper(norm(text))
    return F.when(said.rlike(r"\bFEDERA(?:L|IS)\b"), "FEDERAL").when(said.rlike(r"\bCG[ /-]?IBS\b"), "CGIBS").when(said.rlike(r"\bESTADUA(?:L|IS)\b"), "ESTADUAL").otherwise("")


def act_link(value: Column, number: Column, year: Column, page: str) -> Column:
    """The address of an act from a value of a link table: itself, or the page's with the query that =id stands for; null for '-'."""
    own = F.regexp_extract(F.trim(value), r"^=(\d+)$", 1)
    some = lambda n, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{n}="), F.url_encode(v)))
    query = F.concat_ws("&", F.lit("idStatus=3"), some("numeroAto", number), some("ano", year), F.lit("ordenacao=MAIS_RECENTES"), F.concat(F.lit("idAto="), own))
    return F.when(value == "-", F.lit(None)).when(own != "", F.concat(F.lit(page + "?"), query)).otherwise(value)


def epigraph_year(text: Column) -> Column:
    """The year of an epigraph in upper case: DE 2026, else /2026; empty for none."""
    a, b = F.regexp_extract(text, r"\bDE (\d{4})\b", 1), F.regexp_extract(text, r"/(\d{4})\b", 1)
    return F.when(a != "", a).otherwise(b)


def file_name(title: Column, extension: str) -> Column:
    """A name that every file system takes."""
    name = F.trim(F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|\p{Cntrl}]+', " "), r"\s+", " "))
    return F.concat(F.when(name == "", "documento").otherwise(name), F.lit(f".{extension}"))
