"""Personal data: patterns, and terms whose co-occurrence gives a protected entity away.

Base spans are e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers.
Words that stand near one may reveal it even when it is masked. How strongly is estimated
from the whole corpus, for protected entities of three levels: the value itself, its
group (an e-mail's domain, half an IP address, a card's issuer, a phone number without
its last four digits) and its kind. With N documents, n(c) that contain the entity c, n(t)
that contain the term t and n(c,t) where t stands within REACH words of c, t gives
log2(N p / n(c)) bits about c, where p is the lower limit of Wilson's confidence interval for n(c,t) / n(t).
Its evidence is d, the number of different texts that have the pair, so exact copies add
none, and a pair that fewer than LEAST_TEXTS of them have is none: one mention, or two, can be chance, and the
rarer an entity the more such chances would pass. The
disclosure is the share of those bits in c's own information log2(N / n(c)). Entities that only one
text contains are judged by their group and kind. A term whose disclosure of
anything reaches GENERALISE gives it away wherever it stands: in every document, outside the base spans, it
is replaced by its kind ([NAME], [NUMBER] or [TERM]); from REMOVE on it is removed.

DataFrame functions only. Positions are found by cutting a text at its matches; patterns
are written with possessive quantifiers, so that long runs neither backtrack nor recurse,
and positions come from running sums (`running`) and are looked up by halving, so that a
list of addresses takes little more than time in proportion to its length. Shuffles
carry terms and positions; texts are joined with what is to be marked in them, and only
those that can hold something: an entity, or one of the terms. Counts are aggregated before each shuffle, and
pairs are limited to the words near an entity, so a group of copies or a frequent entity
makes rows in proportion to its mentions; each join has one row a key on its other side.

Defined cases: a null text is an empty one (no spans; `sanitise` leaves it null). Spans
count code points, the end excluded; kinds are matched independently and may overlap.
Repeated rows, and rows with a null doc_id, have their own results. Columns of other
names pass through `sanitise`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravia.llm.common import bound, kept, running, unused

KINDS = ("email", "ip", "card", "phone")
# The leftmost match of a run starts at its beginning or where the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
VALID_IP = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
TERM = r"\p{L}[\p{L}\p{M}\p{N}_]++"

REACH = 6
GENERALISE, REMOVE = 0.6, 0.85
#: Different texts that must have a pair, and the standard errors that the confidence limit lies below the estimate.
LEAST_TEXTS, ERRORS = 3, 1.96
#: Disclosing terms that are broadcast at most; beyond, they meet the words of all texts by a shuffle.
BROADCAST_TERMS = 50_000
#: Code points of a text that are looked through to cut a piece out of it.
BLOCK = 1024


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = bound(found, lambda f: F.zip_with(f, F.slice(gaps, F.lit(1), F.size(f)), lambda m, g: F.struct((F.length(g) + F.length(m)).alias("step"), F.length(m).alias("long"), m.alias("value"))))

    def placed(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda p: p["step"]), lambda x, y: x + y)
        return F.zip_with(rows, ends, lambda p, end: F.struct((end - p["long"]).alias("start"), end.alias("end"), p["value"].alias("value")))

    return bound(pairs, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(F.filter(each, lambda d: d.isNotNull()), lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string>>")


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, name, entity>> by start, then kind as in KINDS. text is not null."""
    card_length = lambda m: F.length(_digits(m["value"]))
    by_kind = {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP), lambda m: m["value"].rlike(VALID_IP))).otherwise(_none()),
        "card": F.when(
            text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
            F.filter(F.filter(matches(text, CARD), lambda m: card_length(m).between(12, 19)), lambda m: luhn(_digits(m["value"]))),
        ).otherwise(_none()),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda m: card_length(m).between(9, 15))).otherwise(_none()),
    }
    def labelled(i: int, kind: str, found: Column) -> Column:
        entity = F.lower if kind == "email" else _digits if kind in ("card", "phone") else lambda v: v
        return F.transform(
            found,
            lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind"), m["end"].alias("end"), F.lit(kind).alias("name"), F.concat(F.lit(kind + ":"), entity(m["value"])).alias("entity")),
        )

    return F.sort_array(F.concat(*(labelled(i, kind, found) for i, (kind, found) in enumerate(by_kind.items()))))


def _before(rows: Column, at: Column) -> Column:
    """How many rows (by start) start before a position, by halving."""
    n = F.size(rows)

    def half(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        less, open_ = F.get(rows, middle)["start"] < at, a["low"] < a["high"]
        return F.struct(F.when(open_ & less, middle + 1).otherwise(a["low"]).alias("low"), F.when(open_ & ~less, middle).otherwise(a["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(n))), F.struct(F.lit(0).alias("low"), n.alias("high")), half, lambda a: a["low"])


def merged(spans: Column) -> Column:
    """array<struct<start, end, name>>: spans (by start) that overlap are one, with the first one's name."""

    def joined(reach: Column) -> Column:
        fresh = lambda s, i: (i == 0) | (s["start"] >= F.get(reach, i - 1))
        numbered = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["name"].alias("name"), i.alias("i"), fresh(s, i).alias("fresh")))
        last = lambda f, j: F.coalesce(F.get(f, j + 1)["i"], F.size(reach)) - 1
        return bound(F.filter(numbered, lambda s: s["fresh"]), lambda f: F.transform(f, lambda s, j: F.struct(s["start"].alias("start"), F.get(reach, last(f, j)).alias("end"), s["name"].alias("name"))))

    return bound(running(F.transform(spans, lambda s: s["end"]), F.greatest), joined)


def _near(terms: Column, spans: Column, one: Column) -> Column:
    """array<struct<entity, term, start, end>>: the words within REACH of each span, outside all spans.

    terms: as of matches(text, TERM); one: as of merged(spans). Of a word that an edge of the
    span cuts, the part outside is taken for a word if it is one.
    """
    word = lambda start, end, value: F.struct(start.alias("start"), end.alias("end"), value.alias("value"))

    def left(span: Column) -> Column:
        n = _before(terms, span["start"])
        last = F.slice(terms, F.greatest(F.lit(1), n - REACH), F.least(n, F.lit(REACH + 1)))
        cut = F.filter(F.transform(last, lambda m: word(m["start"], F.least(m["end"], span["start"]), F.substring(m["value"], F.lit(1), span["start"] - m["start"]))), lambda m: m["end"] - m["start"] > 1)
        return F.slice(cut, F.greatest(F.lit(1), F.size(cut) - (REACH - 1)), F.lit(REACH))

    def right(span: Column) -> Column:
        n = _before(terms, span["end"])
        over = F.filter(F.slice(terms, F.greatest(F.lit(1), n), F.least(n, F.lit(1))), lambda m: m["end"] > span["end"])
        tail = lambda m: F.regexp_extract(F.substring(m["value"], span["end"] - m["start"] + 1, m["end"] - span["end"]), TERM, 0)
        rest = F.transform(over, lambda m: word(m["end"] - F.length(tail(m)), m["end"], tail(m)))
        whole = F.transform(F.slice(terms, n + 1, F.lit(REACH)), lambda m: word(m["start"], m["end"], m["value"]))
        return F.slice(F.concat(F.filter(rest, lambda m: m["start"] < m["end"]), whole), F.lit(1), F.lit(REACH))

    def side(span: Column, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(span["entity"].alias("entity"), F.lower(m["value"]).alias("term"), m["start"].alias("start"), m["end"].alias("end")))

    around = F.flatten(F.transform(spans, lambda s: F.concat(side(s, left(s)), side(s, right(s)))))
    return F.filter(around, lambda w: F.coalesce(F.get(one, _before(one, w["end"]) - 1)["end"] <= w["start"], F.lit(True)))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, base, near for each row of docs; key tells texts apart, so (doc_id, key) tells rows apart but for exact repeats."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), text.alias("t"))
    rows = rows.withColumn("base", base_spans(F.col("t")))
    some = F.size("base") > 0
    rows = rows.withColumn("terms", F.when(some, matches(F.col("t"), TERM)).otherwise(_none()))
    rows = rows.withColumn("one", F.when(some, merged(F.col("base"))).otherwise(F.array()))
    return rows.select("doc_id", "key", "base", F.when(some, _near(F.col("terms"), F.col("base"), F.col("one"))).otherwise(F.array()).alias("near"))


def levels(entity: Column) -> Column:
    """An entity's value, group and kind."""
    kind, value = F.substring_index(entity, ":", 1), F.substring(entity, F.locate(":", entity) + F.lit(1), F.length(entity))
    group = (
        F.when(kind == "email", F.substring_index(value, "@", -1))
        .when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(value, 1, 6))
        .otherwise(F.substring(value, F.lit(1), F.length(value) - 4))
    )
    return F.array(entity, F.concat(kind, F.lit(" of "), group), kind)


def lower_limit(share: Column, hits: Column, errors: float = ERRORS) -> Column:
    """The lower limit of Wilson's interval for a share that was seen in `hits` cases and not in hits / share - hits others."""
    n, z2 = hits / share, errors * errors
    return (share + z2 / (2 * n) - errors * F.sqrt((share * (1 - share) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def words_of(docs: DataFrame) -> DataFrame:
    """The columns of docs but the text, and term: each word of a text once."""
    return docs.select(*(c for c in docs.columns if c != "text"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))


def disclosing(docs: DataFrame, found: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """entity, term, disclosure for the pairs that reach the threshold. found: as of found_spans(docs)."""
    some = found.where(F.size("base") > 0)
    # text, since lists of texts are made distinct by hashing and lists of structs are not
    joint = F.flatten(F.transform("near", lambda w: F.transform(levels(w["entity"]), lambda x: F.concat(x, F.lit("\0"), w["term"]))))
    pairs = some.select("key", F.explode(F.array_distinct(joint)).alias("p")).groupBy("p", "key").agg(F.count("*").alias("n"))
    together = pairs.groupBy("p").agg(F.sum("n").alias("n_ct"), F.count("*").alias("d")).where(F.col("d") >= LEAST_TEXTS)
    together = together.select(F.substring_index("p", "\0", 1).alias("entity"), F.substring_index("p", "\0", -1).alias("term"), "n_ct", "d")
    entities = some.select("key", F.explode(F.array_distinct(F.flatten(F.transform("base", lambda s: levels(s["entity"]))))).alias("entity"))
    entities = entities.groupBy("entity").agg(F.count("*").alias("n_c"), F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").drop("a", "b")
    terms = words_of(docs.select("text")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.select(F.lit(1)).groupBy().agg(F.count("*").alias("n"))
    # of kinds there are as many as KINDS; the others are met by their key, so that no task holds all pairs of a kind
    kind = F.col("entity").isin(*KINDS)
    counted = together.where(kind).join(F.broadcast(entities.where(kind)), "entity").unionByName(together.where(~kind).join(entities.where(~kind), "entity"))
    scored = counted.join(terms, "term").join(F.broadcast(total))  # one row
    p = lower_limit(F.col("n_ct") / F.col("n_t"), F.col("d"))
    share = F.log2(F.col("n") * p / F.col("n_c")) / F.log2(F.col("n") / F.col("n_c"))
    return scored.where("n_c < n").select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= generalise)


def marks(docs: DataFrame, found: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """term, name: each term that discloses something, with what becomes of it, `term` or `removed`. found: as of found_spans(docs)."""
    name = F.when(F.max("disclosure") >= remove, "removed").otherwise("term")
    return disclosing(docs, found, generalise).groupBy("term").agg(name.alias("name"))


def _named_words(text: Column, names: Column) -> Column:
    """array<struct<start, kind, end, name>>: the words outside the base spans that names (a map) knows. Each part is bound, so that it is computed once a text."""
    gap = lambda s: F.repeat(F.lit(" "), s["end"] - s["start"])
    clear = lambda one: F.when(F.size(one) == 0, text).otherwise(bound(in_blocks(text), lambda blocks: replaced(blocks, one, gap)))
    known = lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), m["end"].alias("end"), names[F.lower(m["value"])].alias("name"))
    words = bound(base_spans(text), lambda base: bound(merged(base), lambda one: bound(clear(one), lambda t: matches(t, TERM))))
    return F.filter(F.transform(words, known), lambda m: m["name"].isNotNull())


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, key, added: array<struct<start, kind, end, name>> of the terms' occurrences outside the base spans, for the texts that have such words; once for equal rows. terms: as of marks()."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    sent = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    having = words_of(rows).join(sent, "term").groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_set(F.struct("term", "name"))).alias("names"))
    having = kept(having.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "names"))
    held = rows.join(having, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).drop("d", "k").dropDuplicates(["doc_id", "key"])
    return held.select("doc_id", "key", _named_words(F.col("text"), F.col("names")).alias("added"))


def all_spans(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, bool]:
    """doc_id, key, base, added for each row of docs, and whether any term is marked. added: array<struct<start, kind, end, name>>, name `term` or `removed`."""
    found = kept(found_spans(docs))
    terms = kept(marks(docs, found, generalise, remove))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")
    if terms.isEmpty():
        return found.select("doc_id", "key", "base", none.alias("added")), False
    added = kept(occurrences(docs, terms)).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "added")
    joined = found.join(added, found["doc_id"].eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return joined.select("doc_id", "key", "base", F.coalesce("added", none).alias("added")), True


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _joint(base: Column, added: Column) -> Column:
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["name"].alias("name")))
    return F.sort_array(F.concat(plain, added))


def op3(docs: DataFrame) -> DataFrame:
    spans, _ = all_spans(docs)
    named = lambda kind: F.size(F.filter("base", lambda s: s["name"] == kind))
    counts = [named(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(_joint(F.col("base"), F.col("added"))).alias("spans"))


def in_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The text from start to end; blocks: the text in blocks of BLOCK code points."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.ceil(end / BLOCK).cast("int") - first), "")
    return F.when(end > start, F.substring(some, start - first * BLOCK + 1, end - start)).otherwise("")


def replaced(blocks: Column, spans: Column, shown: Callable[[Column], Column]) -> Column:
    """A text (in blocks) with shown(span) in place of each span. spans: as of merged()."""
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    parts = F.transform(spans, lambda s, i: F.concat(piece(blocks, before(i), s["start"]), shown(s)))
    tail = piece(blocks, before(F.size(spans)), F.size(blocks) * BLOCK)
    return F.concat(F.array_join(parts, ""), tail)


def mask(blocks: Column, spans: Column) -> Column:
    """A text (in blocks) with each span replaced: base kinds by their name, terms by their kind, removed terms by nothing. spans: as of merged()."""

    def shown(s: Column) -> Column:
        first = F.when(s["name"] == "term", piece(blocks, s["start"], s["start"] + 1))
        kind = F.when(first.rlike(r"^\p{N}"), "[NUMBER]").when(first.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[TERM]")
        return F.when(s["name"] == "removed", "").when(s["name"] == "term", kind).otherwise(F.concat(F.lit("["), F.upper(s["name"]), F.lit("]")))

    return replaced(blocks, spans, shown)


#: Every entity has one of these.
MAY_HOLD = r"@|[0-9]\.[0-9]|\+[0-9]|[0-9](?:[\x20-]?[0-9]){11}"


def sanitise(docs: DataFrame, into: str = "text") -> DataFrame:
    """docs with the spans masked in column `into`. Where no term is marked, texts that cannot hold an entity are not shuffled."""
    d, k, found, blocks = unused(docs, "d", "k", "found", "blocks")
    one = merged(_joint(F.col("base"), F.col("added")))
    spans, any_term = all_spans(docs)
    spans = spans.where((F.size("base") > 0) | (F.size("added") > 0)).select(F.col("doc_id").alias(d), F.col("key").alias(k), one.alias(found)).dropDuplicates([d, k])
    may = F.lit(True) if any_term else F.coalesce(F.col("text").rlike(MAY_HOLD), F.lit(False))
    held = docs.where(may)
    joined = held.join(spans, held["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(held["text"]) == F.col(k)), "left")
    joined = joined.withColumn(blocks, F.when(F.col(found).isNotNull(), in_blocks(F.col("text"))))
    masked = joined.withColumn(into, F.when(F.col(found).isNull(), F.col("text")).otherwise(mask(F.col(blocks), F.col(found))))
    return masked.drop(d, k, found, blocks).unionByName(docs.where(~may).withColumn(into, F.col("text")))


def stage(docs: DataFrame) -> DataFrame:
    """docs with personal data masked; n_chars follows the text."""
    done = sanitise(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)
