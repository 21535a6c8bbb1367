"""Operators on files, bundles, sessions and jobs kept as tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravia.operators.journeys import with_sum_before


def content_key(day: Column, coords: Column) -> Column:
    """Identity of a recording: its day and its coordinates as text."""
    return F.sha2(F.concat_ws("|", F.coalesce(day, F.lit("")), coords), 256)


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. A minimum of structs: combined before the shuffle, unlike a ranking window."""
    rest = [c for c in rows.columns if c not in keys]
    lead = [*order, *(c for c in rest if c not in order)]
    return rows.groupBy(*keys).agg(F.min(F.struct(*lead)).alias("__m")).select(*keys, *(F.col(f"__m.{c}").alias(c) for c in rest)).select(rows.columns)


def new_only(arrived: DataFrame, known: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose key is not known, the first of each key in what arrived."""
    return first_of_each(arrived, keys, order).join(known.select(*keys), list(keys), "left_anti")


def bundle_digest(assets: DataFrame, length: int = 12) -> DataFrame:
    """bundle, digest: of the sorted name:sha lines. Lines are sorted by Spark and hashed as they come, so a bundle of any size takes no memory; a digest over all of its lines in order is made in one go, by one task a bundle."""
    lines = assets.select("bundle", F.concat_ws(":", "name", "sha").alias("line")).repartition("bundle").sortWithinPartitions("bundle", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda b, h: pa.RecordBatch.from_pydict({"bundle": pa.array([b], kind), "digest": [h.hexdigest()[:length]]})
        held, hashed, kind = None, None, pa.string()
        for batch in batches:
            kind = batch.schema.field("bundle").type
            for bundle, line in zip(batch.column("bundle").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if hashed is None or bundle != held:
                    if hashed is not None:
                        yield made(held, hashed)
                    held, hashed = bundle, hashlib.sha256(line.encode())
                else:
                    hashed.update(b"\n" + line.encode())
        if hashed is not None:
            yield made(held, hashed)

    return lines.mapInArrow(run, f"bundle {dict(assets.dtypes)['bundle']}, digest string")


def verify(listed: DataFrame, found: DataFrame) -> DataFrame:
    """bundle, name, verdict for every asset that is listed or found: ok, drift, missing or unlisted."""
    a, b = listed.select("bundle", "name", F.col("sha").alias("want")), found.select("bundle", "name", F.col("sha").alias("have"))
    verdict = F.when(F.col("want").isNull(), "unlisted").when(F.col("have").isNull(), "missing").when(F.col("want") == F.col("have"), "ok").otherwise("drift")
    return a.join(b, ["bundle", "name"], "full").select("bundle", "name", verdict.alias("verdict"))


def merge_index(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """By name: the fresh entry where there is one; assets of both; the prior terrain only where the fresh has none."""
    f = fresh.select("name", F.col("assets").alias("fa"), F.col("terrain").alias("ft"))
    p = prior.select("name", F.col("assets").alias("pa"), F.col("terrain").alias("pt"))
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("fa", none), F.coalesce("pa", none)))
    return f.join(p, "name", "full").select("name", both.alias("assets"), F.coalesce("ft", "pt").alias("terrain"))


def merged_assets(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """name, asset: what both sides have (name, asset), once; as rows, however many a name has."""
    return fresh.select("name", "asset").union(prior.select("name", "asset")).distinct()


def merged_terrain(fresh: DataFrame, prior: DataFrame) -> DataFrame:
    """name, terrain: the prior one only where the fresh side has none. fresh, prior: name, terrain, a row a name."""
    f, p = fresh.select("name", F.col("terrain").alias("ft")), prior.select("name", F.col("terrain").alias("pt"))
    return f.join(p, "name", "full").select("name", F.coalesce("ft", "pt").alias("terrain"))


def latest(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest record of each key; a maximum of structs, combined before the shuffle."""
    rest = [c for c in log.columns if c != key]
    lead = [*order, *(c for c in rest if c not in order)]
    return log.groupBy(key).agg(F.max(F.struct(*lead)).alias("__m")).select(key, *(F.col(f"__m.{c}").alias(c) for c in rest))


def patched(log: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """The state that a log of partial updates leaves: each field's last value that is not null."""
    return log.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def expired(records: DataFrame, live: DataFrame, key: str, at: str, now: float, ttl_s: float) -> DataFrame:
    """Records older than the time to live that no live row still names."""
    return records.where(F.col(at) < now - ttl_s).join(live.select(key).distinct(), key, "left_anti")


def append_lineage(history: Column, entry: Column, most: int = 100) -> Column:
    """The newest `most` entries, the new one last."""
    longer = F.concat(history, F.array(entry))
    return F.when(F.size(longer) > most, F.slice(longer, -most, most)).otherwise(longer)


def next_edition(edition: Column, most: int = 999) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(0), F.coalesce(edition, F.lit(1))) + 1)


Rule = tuple[str, Column]


def first_error(rules: Sequence[Rule]) -> Column:
    """The code of the first rule that a row breaks, null if none; a rule that cannot be decided is broken."""
    out = F.lit(None).cast("string")
    for code, good in reversed(rules):
        out = F.when(~F.coalesce(good, F.lit(False)), code).otherwise(out)
    return out


def archive_names_ok(names: Column, folder: Column, allowed: Sequence[str]) -> Column:
    """Members all lie in the folder, are allowed, differ, and include the sources."""
    inside = F.forall(names, lambda n: F.startswith(n, F.concat(folder, F.lit("/"))) & F.substring(n, F.length(folder) + 2, F.length(n)).isin(*allowed))
    return inside & (F.size(F.array_distinct(names)) == F.size(names)) & F.array_contains(names, F.concat(folder, F.lit("/sources.json")))


def same_sets(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as sets: repeats do not count, order of rows does not either, and nulls are equal."""
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def guarded(requests: DataFrame, known: DataFrame, regions: DataFrame) -> DataFrame:
    """requests (request, session_id, format) with status and why: 404 where the session or its region is not there, 422 where it has no accepted sheet or the format is not one it has, else 200.

    known: session_id, region_id, stamped, formats; regions: region_id.
    """
    there = regions.select("region_id", F.lit(True).alias("built"))
    rows = requests.join(known, "session_id", "left").join(there, "region_id", "left")
    why = (
        F.when(F.col("region_id").isNull(), "no_session")
        .when(F.col("built").isNull(), "no_region")
        .when(~F.coalesce("stamped", F.lit(False)), "not_accepted")
        .when(~F.coalesce(F.array_contains("formats", F.lower(F.col("format"))), F.lit(False)), "format")
    )
    status = F.when(why.isin("no_session", "no_region"), 404).when(why.isNotNull(), 422).otherwise(200)
    return rows.select("request", status.alias("status"), why.alias("why"))


def plate_check(files: DataFrame, plates: DataFrame, allow_mismatch: bool = False) -> DataFrame:
    """file, verdict of files (file, region_id, version) against what is built (region_id, version): no_region, mismatch, or ok; versions that are unknown on either side are not compared."""
    have = plates.select("region_id", F.col("version").alias("built"), F.lit(True).alias("there"))
    other = F.col("version").isNotNull() & F.col("built").isNotNull() & (F.col("version") != F.col("built"))
    verdict = F.when(F.col("there").isNull(), "no_region").when(other & F.lit(not allow_mismatch), "mismatch").otherwise("ok")
    return files.join(have, "region_id", "left").select("file", verdict.alias("verdict"))


def unique_ids(fresh: DataFrame, taken: DataFrame, most: int = 99) -> DataFrame:
    """fresh (nth, slug) with id: the slug itself if it is free, else slug_2, slug_3 ... in order of nth; null when none is left. taken: id."""
    number = F.when(F.col("id").rlike("_([2-9]|[1-9][0-9])$"), F.regexp_extract("id", "_([0-9]+)$", 1).cast("int"))
    used = taken.select(F.explode(F.array(F.struct(F.col("id").alias("slug"), F.lit(1).alias("n")), F.struct(F.regexp_replace("id", "_[0-9]+$", "").alias("slug"), number.alias("n")))).alias("u"))
    used = used.select("u.slug", "u.n").where("n IS NOT NULL").groupBy("slug").agg(F.collect_set("n").alias("used"))  # at most `most` numbers
    place = F.row_number().over(Window.partitionBy("slug").orderBy("nth"))
    free = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: ~F.array_contains(F.coalesce("used", F.array().cast("array<int>")), n))
    n = F.get(free, F.col("place") - 1)
    rows = fresh.withColumn("place", place).join(used, "slug", "left")
    return rows.select("nth", "slug", F.when(n == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), n.cast("string"))).alias("id"))


def safe_key(key: Column) -> Column:
    """A nested key of a store in its plain form; null where it would leave the store. Parts are compared, not prefixes."""
    parts = F.filter(F.split(key, "/"), lambda p: (p != "") & (p != "."))
    # going up is allowed as long as it stays inside
    walked = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("good")),
        lambda a, p: F.struct(
            F.when((p == "..") & (F.size(a["at"]) > 0), F.slice(a["at"], F.lit(1), F.size(a["at"]) - 1)).when(p == "..", a["at"]).otherwise(F.concat(a["at"], F.array(p))).alias("at"),
            (a["good"] & ((p != "..") | (F.size(a["at"]) > 0))).alias("good"),
        ),
        lambda a: F.when(a["good"] & (F.size(a["at"]) > 0), F.array_join(a["at"], "/")),
    )
    return F.when(~F.startswith(key, F.lit("/")), walked)


def grouped_jobs(jobs: DataFrame) -> DataFrame:
    """name, alone, members, first, place: groups of jobs, numbered in order of their first job, then jobs without a group, each by itself and numbered anew. jobs: seq, jid, name; seq tells jobs apart."""
    groups = jobs.groupBy(F.col("name"), F.when(F.col("name").isNull(), F.col("jid")).alias("alone")).agg(F.min("seq").alias("first"), F.count("*").alias("members"))
    single = F.col("name").isNull()
    before = with_sum_before(groups, [single, "first"], F.lit(1), "before")
    named = before.where(~single).count()
    return before.select("name", "alone", "members", "first", (F.col("before") + 1 - F.when(single, named).otherwise(0)).cast("int").alias("place"))
