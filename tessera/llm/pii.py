"""Personal data: spans found by pattern, and terms whose co-occurrence with them discloses them.

Values found by pattern (e-mail and IP addresses, card and phone numbers) are the protected entities. How strongly a term t of
the same text reveals an entity e is estimated from the corpus as pointwise mutual information,
``PMI(e, t) = log2(p(e, t) / (p(e) p(t)))`` over documents. A term (any run of letters, marks and digits) discloses e if it gives
away at least the share ``1/alpha`` of e's information content, ``PMI >= -log2 p(e) / alpha``, if they meet in ``min_texts``
different texts, and if their meeting is no chance: its evidence, as bits of a Poisson tail, must exceed by ``min_bits`` those
that the number of pairs looked at makes likely, so equal evidence decides alike at every size. In texts that hold the entity,
such terms are spans of kind ``term``; redaction generalises every span to the name of its kind.

A term in very many texts can't reach the share for a rare entity, whatever it meets; so terms are counted before they are paired
with a text's entities, and common ones are not paired at all. Equal texts are one text with a weight: they are paired once, and
the places of its terms hold for each of its rows.

Everything is built-in DataFrame functions. Patterns are written with possessive loops, which read a text in linear time and
find the same matches. Defined cases: a null text is empty; rows without an id are treated as all others; repeated rows give
repeated results and count as one text for ``min_texts``; texts of any length are read whole; terms at a threshold disclose;
spans may overlap across kinds and are ordered by start, then kind; empty tables give empty results; other input columns are not
looked at, and stay in ``redact``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.storage import materialize

KINDS = ("email", "ip", "card", "phone", "term")

# A match can begin at the end of the one before (\G) or where no other character of its first run stands before.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_HOLDER = r"@|[0-9]"  # what every text with an entity has
_TERM = r"[\p{L}\p{M}\p{N}]++"
_SPANS = "array<struct<start:int,k:int,end:int,value:string>>"
_CHUNK = 128  # numbers summed one by one


def _holds(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(xs: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _CHUNK).cast("int")), lambda k: F.slice(xs, k * _CHUNK + 1, _CHUNK))


def _before(numbers: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array what ``add`` makes, from 0 on, of those before it. Appending to an array copies it, so numbers are
    taken by chunks, and the chunks' totals then added: work is proportional to the array up to millions of numbers."""
    append = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    running = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), append)["out"]
    total = lambda xs: F.aggregate(xs, F.lit(0), add)
    chunked = lambda cs: F.flatten(F.zip_with(running(F.transform(cs, total)), F.transform(cs, running), lambda first, own: F.transform(own, lambda v: add(first, v))))
    return _let(numbers, lambda xs: F.when(F.size(xs) <= _CHUNK, running(xs)).otherwise(_let(_chunks(xs), chunked)))


def _places(text: Column, pattern: str, k: int, value: Callable[[Column], Column], holds: Callable[[Column], Column]) -> Column:
    """array<struct<start, k, end, value>> of a pattern's matches; the pieces between them give their places."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("p"), F.coalesce(F.length(m), F.lit(0)).alias("n"), m.alias("m")))

    def placed(xs: Column) -> Column:
        before = _before(F.transform(xs, lambda x: x["p"] + x["n"]), lambda a, b: a + b)
        spans = F.zip_with(xs, before, lambda x, at: F.when(x["m"].isNotNull() & holds(x["m"]), F.struct((at + x["p"]).alias("start"), F.lit(k).alias("k"), (at + x["p"] + x["n"]).alias("end"), value(x["m"]).alias("value"))))
        return F.filter(spans, lambda v: v.isNotNull())

    return _let(both, placed)


def _found(text: Column, kind: str) -> Column:
    found = _places(text, _PATTERNS[kind], KINDS.index(kind), lambda m: m, lambda m: _holds(kind, m))
    return F.when(text.rlike(_NEEDS[kind]), found).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """All spans found by pattern, by start, then kind."""
    return F.array_sort(F.concat(*(_found(text, k) for k in KINDS[:4])))


def _entity(span: Column) -> Column:
    plain = F.when(span["k"] >= 2, F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat(span["k"].cast("string"), F.lit(":"), plain)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _base(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, base spans, distinct entities and, where there are any, text_hash of every row, without the text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    found = found.withColumn("entities", F.array_distinct(F.transform("spans", _entity)))
    return found.select("doc_id", "spans", "entities", F.when(F.size("entities") > 0, F.md5("text")).alias("text_hash"))


def _terms(text: str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def disclosing(docs: DataFrame, base: DataFrame, text_column: str, alpha: float, min_texts: int, min_bits: float, most_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """(entity, term) of the disclosing terms, and (text_hash, text, n_rows, entities) of the different texts that hold entities."""
    total = float(base.count())
    holders = base.where("text_hash is not null").groupBy("text_hash").agg(F.count("*").alias("n_rows"), F.first("entities").alias("entities"))
    single = materialize(holders.select("text_hash", "n_rows", F.explode("entities").alias("entity")), "holders")
    entities = single.groupBy("entity").agg(F.sum("n_rows").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= min_texts).drop("texts")
    # Where n_both <= n_entity, the share can only be reached by terms in so many documents at most.
    reach = F.col("n_entity") * F.pow(F.lit(total) / F.col("n_entity"), F.lit(1 - 1 / alpha)) * (1 + 1e-9)
    entities = materialize(entities.withColumn("reach", reach), "entities")
    held = single.join(entities, "entity").groupBy("text_hash").agg(F.first("n_rows").alias("n_rows"), F.collect_list(F.struct("entity", "n_entity", "reach")).alias("entities"), F.max("reach").alias("reach"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(text.alias("text"))
    near = texts.where(F.col("text").rlike(_HOLDER)).withColumn("text_hash", F.md5("text")).join(materialize(held, "held"), "text_hash")
    near = materialize(near.groupBy("text_hash").agg(*(F.first(c).alias(c) for c in ("text", "n_rows", "entities", "reach"))), "near")
    terms = near.select("text_hash", F.explode(_terms("text")).alias("term"))
    wanted = materialize(terms.select("term").distinct(), "terms")
    words = texts.select(F.explode(_terms("text")).alias("term"))
    if wanted.count() <= most_broadcast:
        counted = words.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    else:  # counted in each task before anything moves
        counted = words.groupBy("term").agg(F.count("*").alias("n_term")).join(wanted, "term", "left_semi")
    most = near.agg(F.max("reach").alias("m")).first().m or 0.0
    counted = materialize(counted.where(F.col("n_term") <= most), "counted")
    rare = terms.join(counted, "term").join(near.select("text_hash", "n_rows", "entities"), "text_hash")
    paired = rare.select("term", "n_term", "n_rows", F.explode(F.filter("entities", lambda e: e["reach"] >= F.col("n_term"))).alias("e"))
    together = paired.groupBy("e.entity", "e.n_entity", "term", "n_term").agg(F.sum("n_rows").alias("n_both"), F.count("*").alias("texts"))
    together = materialize(together, "together")
    pairs = together.count()
    ratio = F.col("n_both") * F.lit(total) / (F.col("n_entity") * F.col("n_term"))
    content = F.log2(F.lit(total) / F.col("n_entity"))
    evidence = F.col("texts") * (F.log2(ratio) - (1 - 1 / ratio) / math.log(2))
    found = together.where((F.col("texts") >= min_texts) & (ratio > 1) & (F.log2(ratio) >= content / alpha) & (evidence >= math.log2(max(pairs, 1)) + min_bits))
    return materialize(found.select("entity", "term"), "disclosing"), near


def term_spans(docs: DataFrame, base: DataFrame, text_column: str, alpha: float = 1.25, min_texts: int = 3, min_bits: float = 7.0, most_broadcast: int = 100_000) -> DataFrame:
    """(text_hash, terms): the disclosing terms' spans in the different texts that hold what they disclose."""
    found, near = disclosing(docs, base, text_column, alpha, min_texts, min_bits, most_broadcast)
    own = near.select("text_hash", F.explode("entities.entity").alias("entity")).join(found, "entity").select("text_hash", "term").distinct()
    own = materialize(own, "own_terms")
    rows = near.select("text_hash", "text").join(own.select("text_hash").distinct(), "text_hash", "left_semi")
    # Every place of a term is a row, which finds its text's terms by hash, however many either are.
    places = rows.select("text_hash", F.explode(_places(F.col("text"), _TERM, KINDS.index("term"), F.lower, lambda m: F.lit(True))).alias("s"))
    kept = places.withColumn("term", F.col("s.value")).join(own, ["text_hash", "term"])
    return kept.groupBy("text_hash").agg(F.sort_array(F.collect_list("s")).alias("terms"))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, counts of base spans, ``base_spans`` and ``all_spans`` (arrays of start, k, end, value) of every row."""
    base = materialize(_base(docs, id_column, text_column), "base_spans")
    terms = materialize(term_spans(docs, base, text_column), "term_spans")
    # Texts without entities have no terms and take no part in the join.
    some = base.where("text_hash is not null").join(terms, "text_hash", "left")
    # A term within a base span is covered already.
    apart = F.filter("terms", lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    every = F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", apart)))
    both = some.select("doc_id", "spans", every.alias("every")).union(base.where("text_hash is null").select("doc_id", "spans", F.col("spans").alias("every")))

    def number(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return both.select("doc_id", *counts, F.col("spans").alias("base_spans"), F.col("every").alias("all_spans"))


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with every span replaced by the name of its kind, as ``<EMAIL>``; overlapping spans become one."""
    base = materialize(_base(docs, id_column, text_column), "base_spans")
    terms = materialize(term_spans(docs, base, text_column), "term_spans")
    # The input's columns travel in one of their own, so none of them can have the name of a helper.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_column).alias("text"))
    maybe = F.coalesce(F.col("text"), F.lit("")).rlike(_HOLDER)
    joined = rows.where(maybe).withColumn("text_hash", F.md5("text")).join(terms, "text_hash", "left")
    spans = joined.withColumn("spans", F.array_sort(F.concat(base_spans(F.col("text")), F.coalesce("terms", F.array().cast(_SPANS)))))
    # A span that no earlier one reaches into opens a cut, and text goes on where the farthest span so far ends.
    opens = _let(F.col("spans"), lambda xs: F.filter(F.zip_with(xs, _before(F.transform(xs, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda x, at: F.struct(x["start"].alias("start"), x["k"].alias("k"), at.alias("at"))), lambda o: o["start"] >= o["at"]))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    # A substring is found from the text's start on, so first what a chunk of cuts covers is taken, and from that the pieces.
    def pieces(cuts: Column) -> Column:
        first = F.get(cuts, F.lit(0))["at"]
        covered = F.substring("text", first + 1, F.element_at(cuts, -1)["start"] - first)
        piece = lambda part, o: F.concat(F.substring(part, o["at"] - first + 1, o["start"] - o["at"]), F.get(names, o["k"]))
        return _let(covered, lambda part: F.array_join(F.transform(cuts, lambda o: piece(part, o)), ""))

    end = F.aggregate("spans", F.lit(0), lambda s, x: F.greatest(s, x["end"]))
    clean = F.concat(_let(opens, lambda cuts: F.array_join(F.transform(_chunks(cuts), pieces), "")), F.substring("text", end + 1, F.length("text")))
    clean = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    of = lambda c: F.col(f"row.`{c}`").alias(c)
    return spans.select(*(clean.alias(c) if c == text_column else of(c) for c in docs.columns)).union(rows.where(~maybe).select(*map(of, docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all whole ``documents``."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"), _written(F.col("all_spans")).alias("spans"))
