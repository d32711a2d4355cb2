"""Personal data: patterned entities, and terms that give them away, with built-in DataFrame functions only.

Entities (e-mail, IP, card, phone) are found by pattern in whole texts. A term gives an entity away if seeing the term
tells most of what there is to know of the entity: over the corpus, with N documents,

    log2(N * n(term, entity) / (n(term) * n(entity)))  >=  DISCLOSURE * log2(N / n(entity)),

where n(entity) counts the documents that hold the entity, n(term, entity) those where the term stands in one of its
contexts (NEAR words on either side), and n(term) those that hold the term. All count documents, each copy as one.
Pairs seen in fewer than SUPPORT documents are left alone. Such terms are marked wherever they stand.

In sanitised text entities become their kind's name. A disclosing term with digits is generalised, each digit to `#`, unless its
general form (counted like a term, over all terms that share it) discloses an entity too; other disclosing terms are removed.

Texts are read once for the entities' contexts, once for the counts of candidate terms and once for the result; they are neither
stored nor shuffled. Only contexts, counts and the digests of texts that hold a disclosing term are (with more such texts than
BROADCAST_TEXTS, the texts are joined to them by one shuffle).

All patterns run in time linear in the text and without recursion, so long texts are safe.

Defined results: null text: as an empty one (no spans; sanitised text stays null); equal texts get equal results; null
ids are kept; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions.arrays import let, most_before, placed
from loomtext.llm.common import spill, table

#: Kinds and patterns of the contract (fixed values), possessive where that changes no match.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "[A-Za-z0-9-]++"
KINDS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for its kind's pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
NEAR, SUPPORT, DISCLOSURE = 5, 3, 0.9
#: A term has at least so many letters or digits.
TERM_LENGTH = 3
#: The terms are broadcast only when counted to be at most so many; more are joined by shuffle.
BROADCAST_TERMS = 50_000
#: The same for the digests of texts that hold a disclosing term (and for the terms in them, all together).
BROADCAST_TEXTS = 100_000
#: Characters on either side of an entity that are searched for its context first.
WINDOW = 256
_WORD, _NO_WORD = r"[\p{L}\p{N}]++", r"[^\p{L}\p{N}]++"
_TERM = "term"
SPAN = "struct<kind: string, start: long, end: long, value: string, instead: string>"
HELD = "array<struct<word: string, instead: string>>"


def _located(text: Column, pattern: str | Column, kind: str, instead=None) -> Column:
    """Array of spans of a pattern's matches, in order; offsets in code points, from the pieces between the matches."""
    form = pattern if isinstance(pattern, Column) else F.lit(pattern)
    found = placed(F.split(text, form, -1), F.regexp_extract_all(text, form, F.lit(0)), F.length, "long")
    put = instead or (lambda _: F.lit(f"[{kind.upper()}]"))
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("value"), put(m["text"]).alias("instead")))


def _luhn(digits: Column) -> Column:
    """Whether the digits' check sum holds."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _fits(kind: str):
    return lambda span: _holds(kind, span["value"])


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def entities(text: Column) -> dict[str, Column]:
    """By kind: the array of spans in a text."""
    none = F.array().cast(f"array<{SPAN}>")
    text = F.coalesce(text, F.lit(""))
    out = {}
    for kind, pattern in KINDS.items():
        likely = text.rlike(pattern) & text.contains(HINTS[kind])
        spans = F.filter(_located(text, pattern, kind), _fits(kind))
        out[kind] = F.when(likely, spans).otherwise(none)
    return out


def _beside(text: Column, span: Column, left: bool) -> Column:
    """The words before or after a span, nearest first, at most NEAR; a window is enough where it holds one more."""
    start, end = span["start"].cast("int"), span["end"].cast("int")
    whole = F.substring(text, F.lit(1), start) if left else F.substring(text, end + 1, F.length(text))
    window = F.substring(text, F.greatest(start - WINDOW, F.lit(0)) + 1, F.least(start, F.lit(WINDOW))) if left else F.substring(text, end + 1, F.lit(WINDOW))
    words = lambda part: F.regexp_extract_all(part, F.lit(_WORD), F.lit(0))
    nearest = lambda found: F.slice(F.reverse(found) if left else found, 1, NEAR)
    return let(words(window), lambda found: nearest(F.when(F.size(found) > NEAR, found).otherwise(words(whole))))


def _general(term: Column) -> Column:
    return F.regexp_replace(term, "[0-9]", "#")


def _context(text: Column, span: Column) -> Column:
    """Terms next to a span and their general forms, each with the entity."""
    around = F.transform(F.concat(_beside(text, span, True), _beside(text, span, False)), F.lower)
    terms = F.filter(around, lambda w: F.length(w) >= TERM_LENGTH)
    both = F.array_distinct(F.concat(terms, F.transform(terms, _general)))
    return F.transform(both, lambda w: F.struct(w.alias("term"), F.lower(span["value"]).alias("entity")))


def disclosing_terms(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, entity, ratio) over a table with text, general forms (with `#`) among the terms; a table in the shared folder."""
    found = docs.select("text", F.concat(*entities(F.col("text")).values()).alias("spans"))
    entities_of = F.array_distinct(F.transform("spans", lambda s: F.lower(s["value"]))).alias("entities")
    near = F.array_distinct(F.flatten(F.transform("spans", lambda s: _context(F.col("text"), s)))).alias("held")
    # One row a document, so that every count below is of documents; sums are made before a shuffle.
    contexts = spill(found.select(entities_of, near), "contexts").filter(F.size("entities") > 0)
    total = F.lit(docs.count())
    often = contexts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= support)
    both = contexts.select(F.explode("held").alias("pair")).select("pair.*").groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_both"))
    pairs = both.filter(F.col("n_both") >= support).join(often, "entity")
    # A term's documents where it is in a context are some of its documents: where they are too many already, the corpus isn't asked.
    terms_of = F.array_distinct(F.transform("held", lambda x: x["term"]))
    least = contexts.select(F.explode(terms_of).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_least"))
    whole_ratio = F.greatest(total, F.col("n_entity") + 1) / F.col("n_entity")
    open_pairs = pairs.join(least, "term").filter(F.col("n_least") <= F.col("n_both") * F.pow(whole_ratio, F.lit(1 - disclosure)) * 1.000001)
    pairs = spill(open_pairs.drop("n_least"), "pairs")
    terms = pairs.select("term").distinct()
    many, general = terms.agg(F.count(F.lit(1)), F.count_if(F.col("term").contains("#"))).first()
    if not many:
        return pairs.select("term", "entity", F.lit(0.0).alias("ratio"))
    words = F.transform(_words(F.col("text")), F.lower)
    forms = F.array_distinct(F.concat(words, F.transform(F.filter(words, lambda w: w.rlike("[0-9]")), _general)) if general else words)
    corpus = docs.select(F.explode(forms).alias("term"))
    held = corpus.join(F.broadcast(terms) if many <= BROADCAST_TERMS else terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    tells = F.log2(whole_ratio * F.col("n_both") / F.greatest("n_term", "n_both"))
    return spill(pairs.join(held, "term").withColumn("ratio", tells / F.log2(whole_ratio)).filter(F.col("ratio") >= disclosure).select("term", "entity", "ratio"), "terms")


def replacements(terms: DataFrame) -> DataFrame:
    """(term, instead) of disclosing terms: their general form where that doesn't disclose, else nothing."""
    names = terms.select("term").distinct()
    plain = names.filter(~F.col("term").contains("#")).withColumn("general", _general(F.col("term")))
    bad = names.filter(F.col("term").contains("#")).select(F.col("term").alias("general"), F.lit(True).alias("bad"))
    keep = (F.col("general") != F.col("term")) & F.col("bad").isNull()
    return plain.join(bad, "general", "left").select("term", F.when(keep, F.col("general")).otherwise("").alias("instead"))


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), _NO_WORD)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def texts_with(docs: DataFrame, terms: DataFrame) -> DataFrame | None:
    """(_pii_key, _pii_held): digests of the texts that hold a disclosing term, with its words there; None if there are no such terms."""
    terms = spill(replacements(terms), "replacements")
    many = terms.count()
    if not many:
        return None
    terms = F.broadcast(terms) if many <= BROADCAST_TERMS else terms
    words = docs.select(_key(F.col("text")).alias("_pii_key"), F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    found = words.withColumn("term", F.lower("word")).join(terms, "term")
    held = spill(found.groupBy("_pii_key").agg(F.collect_set(F.struct("word", "instead")).alias("_pii_held")), "held")
    rows, words_in_all = held.agg(F.count(F.lit(1)), F.sum(F.size("_pii_held"))).first()
    return F.broadcast(held) if rows + (words_in_all or 0) <= BROADCAST_TEXTS else held


def _term_spans(text: Column, held: Column) -> Column:
    """Spans of the words in held, which are whole words of the text."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(held, lambda h: h["word"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return _located(text, pattern, _TERM, lambda word: F.get(F.filter(held, lambda h: h["word"] == word), F.lit(0))["instead"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Id columns, text, one span array for each kind, and `terms`."""
    docs = df.select(*id_cols, F.col(text_col).alias("text"))
    held = texts_with(docs.select("text"), disclosing_terms(docs.select("text")))
    none = F.array().cast(f"array<{SPAN}>")
    kinds = [c.alias(k) for k, c in entities(F.col("text")).items()]
    if held is None:
        return docs.select("*", *kinds, none.alias("terms"))
    terms = F.when(F.col("_pii_held").isNotNull(), _term_spans(F.col("text"), F.col("_pii_held"))).otherwise(none)
    return docs.withColumn("_pii_key", _key(F.col("text"))).join(held, "_pii_key", "left").select(*id_cols, "text", *kinds, terms.alias("terms"))


def sanitised(text: Column, spans: Column) -> Column:
    """Text with its spans replaced by what stands instead of them; of overlapping spans the first one's, the others go with it."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"), s["instead"].alias("instead"))))

    def pieces(ordered: Column) -> Column:
        ends = F.transform(ordered, lambda s: -s["minus_end"])
        placed_spans = F.zip_with(ordered, most_before(ends), lambda s, at: F.struct(s.alias("span"), at.alias("at")))
        shown = F.filter(placed_spans, lambda x: x["span"]["start"] >= x["at"])
        gap = lambda x: F.substring(text, (x["at"] + 1).cast("int"), (x["span"]["start"] - x["at"]).cast("int"))
        rest = F.substring(text, (F.array_max(ends) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(shown, lambda x: F.concat(gap(x), x["span"]["instead"])), ""), rest)

    return F.when(F.size(spans) > 0, let(order, pieces)).otherwise(text)


def sanitise(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns and rows with sanitised text; n_chars, where there is one, follows the new text."""
    others = [c for c in df.columns if c != text_col]
    held = df.select(F.struct(*others).alias("_row"), F.col(text_col).alias("text"))
    found = find_pii(held, ["_row"]).withColumn("_spans", F.concat(*KINDS, "terms"))
    out = found.select("_row.*", sanitised(F.col("text"), F.col("_spans")).alias(text_col)).select(*df.columns)
    return out.withColumn("n_chars", F.length(text_col).cast(df.schema["n_chars"].dataType)) if "n_chars" in others else out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.concat(*KINDS)), 256).alias("base_sha256"), joined(F.concat(*KINDS, "terms")).alias("spans"))
