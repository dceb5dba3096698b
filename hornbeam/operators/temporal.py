"""Events and validity intervals. Ranges are half-open; an open end is null; times are UTC."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def utc_micros(text: str) -> int:
    """Microseconds of a date (midnight UTC) or an RFC 3339 time; a time without a zone is refused."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        at = datetime.fromisoformat(text).replace(tzinfo=timezone.utc)
    else:
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})", text):
            raise ValueError(f"not a date or a time with a zone: {text}")
        at = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text).replace("Z", "+00:00"))
    return (at - _EPOCH) // timedelta(microseconds=1)


def instant(x: str | int) -> Column:
    return F.timestamp_micros(F.lit(utc_micros(x) if isinstance(x, str) else int(x)).cast("long"))


def _check(start, end) -> None:
    a, b = (utc_micros(x) if isinstance(x, str) else x for x in (start, end))
    if a >= b:
        raise ValueError("a range must end after it starts")


def on_day(events: DataFrame, date: str, at: str = "at") -> DataFrame:
    """Events in the UTC day."""
    a = utc_micros(date)
    return events.filter((F.col(at) >= instant(a)) & (F.col(at) < instant(a + 86_400_000_000)))


def between(events: DataFrame, start: str, end: str, at: str = "at") -> DataFrame:
    _check(start, end)
    return events.filter((F.col(at) >= instant(start)) & (F.col(at) < instant(end)))


def after(events: DataFrame, when: str, limit: int | None = None, at: str = "at", ident: str = "id") -> DataFrame:
    """Events later than a time, in order, the first ``limit``."""
    out = events.filter(F.col(at) > instant(when)).orderBy(at, ident)
    return out.limit(limit) if limit is not None else out


def before(events: DataFrame, when: str, limit: int | None = None, at: str = "at", ident: str = "id") -> DataFrame:
    """The last ``limit`` events earlier than a time, in ascending order."""
    out = events.filter(F.col(at) < instant(when))
    if limit is not None:
        out = out.orderBy(F.col(at).desc(), F.col(ident).desc()).limit(limit)
    return out.orderBy(at, ident)


def valid_at(intervals: DataFrame, when: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    t = instant(when)
    return intervals.filter((F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t)))


def valid_overlaps(intervals: DataFrame, start_at: str, end_at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    _check(start_at, end_at)
    return intervals.filter((F.col(start) < instant(end_at)) & (F.col(end).isNull() | (F.col(end) > instant(start_at))))


def overlap_join(left: DataFrame, right: DataFrame, key: list[str], bucket_seconds: int = 86_400, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Pairs of intervals of one key that overlap, as (left_*, right_*).

    Closed intervals meet in time buckets, so that a key with many intervals is
    split; a pair is reported in the bucket of its later start only. Open
    intervals join on the key alone, as they overlap without bound.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*(F.col(k) for k in key), *(F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in key))

    b_ = f"b_{uuid.uuid4().hex[:8]}"
    a, b = side(left, "left"), side(right, "right")
    bucket = lambda c: F.floor(F.unix_micros(c) / (bucket_seconds * 1_000_000))
    (as_, ae), (bs, be) = ((F.col(f"{t}_{start}"), F.col(f"{t}_{end}")) for t in ("left", "right"))
    meets = (as_ < F.coalesce(be, F.lit("9999-12-31").cast("timestamp"))) & (bs < F.coalesce(ae, F.lit("9999-12-31").cast("timestamp")))
    closed = lambda df, s, e: df.filter(e.isNotNull()).withColumn(b_, F.explode(F.sequence(bucket(s), bucket(e - F.expr("interval 1 microsecond")))))
    one = closed(a, as_, ae).join(closed(b, bs, be), [*key, b_]).filter(meets & (F.col(b_) == bucket(F.greatest(as_, bs)))).drop(b_)
    two = a.filter(ae.isNull()).join(b, key).filter(meets)
    three = a.filter(ae.isNotNull()).join(b.filter(be.isNull()), key).filter(meets)
    return one.unionByName(two).unionByName(three)


def as_of(versions: DataFrame, probes: DataFrame, key: str, at: str = "at", start: str = "valid_from", bucket_seconds: int = 604_800) -> DataFrame:
    """Each probe (key, at, ...) with the latest version of its key that starts at or before it, or nulls.

    Versions and probes of a key and a time bucket are merged in time order by
    one window; a second window over the buckets of a key, one row each, carries
    the last version of earlier buckets on. So nothing is compared pair by pair,
    and a key with many rows is split by time.
    """
    cols = [c for c in versions.columns if c != key]
    t_, probe_, v_, p_, last_, b_, carry_, k_ = (f"{c}_{uuid.uuid4().hex[:8]}" for c in "tpvqlbck")
    v = versions.select(F.col(key), F.col(start).alias(t_), F.lit(0).alias(probe_), F.struct(*cols).alias(v_))
    names = [c for c in probes.columns if c != key]
    p = probes.select(F.col(key), F.col(at).alias(t_), F.lit(1).alias(probe_), F.struct(*names).alias(p_))
    both = v.unionByName(p, allowMissingColumns=True).withColumn(b_, F.floor(F.unix_micros(t_) / (bucket_seconds * 1_000_000)))
    w = W.partitionBy(key, b_).orderBy(t_, probe_).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumn(last_, F.last(v_, ignorenulls=True).over(w)).filter(F.col(probe_) == 1)
    ends = both.groupBy(F.col(key).alias(k_), b_).agg(F.max_by(v_, F.when(F.col(probe_) == 0, F.col(t_))).alias(v_))
    before = W.partitionBy(k_).orderBy(b_).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(k_, F.col(b_).alias(f"{b_}e"), F.last(v_, ignorenulls=True).over(before).alias(carry_)).filter(F.col(carry_).isNotNull())
    out = out.join(ends, F.col(key).eqNullSafe(F.col(k_)) & (F.col(b_) == F.col(f"{b_}e")), "left").withColumn(last_, F.coalesce(last_, carry_))
    return out.select(key, *(F.col(p_)[c].alias(c) for c in names), *(F.col(last_)[c].alias(f"version_{c}" if c in names else c) for c in cols))


def versions_from_history(history: DataFrame, key: str, start: str = "valid_from") -> DataFrame:
    """An append-only history with ``valid_to``, the start of the next version."""
    return history.withColumn("valid_to", F.lead(start).over(W.partitionBy(key).orderBy(start)))


def stats(intervals: DataFrame, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """total, open_ended, and the earliest and latest start and end."""
    return intervals.agg(F.count("*").alias("total"), F.count_if(F.col(end).isNull()).alias("open_ended"), F.min(start).alias("min_start"), F.max(start).alias("max_start"), F.min(end).alias("min_end"), F.max(end).alias("max_end"))


def projected(entities: DataFrame, profile: str, version: int, kind: str, field: str, starts: Column, ends: Column | None = None) -> DataFrame:
    """Temporal records of entities (id): one a value of ``starts`` (array of time texts), paired with ``ends`` of equal length."""
    pairs = F.arrays_zip(starts.alias("a"), (ends if ends is not None else F.transform(starts, lambda _: F.lit(None).cast("string"))).alias("b"))
    ok = entities if ends is None else entities.filter(F.size(starts) == F.size(ends))
    rows = ok.select("id", F.posexplode(pairs).alias("ordinal", "p"))
    ident = F.concat_ws(":", F.lit(profile), F.lit(str(version)), F.lit(kind), F.lit(field), F.col("ordinal").cast("string"))
    return rows.select(F.concat_ws("/", "id", ident).alias("record_id"), "id", F.to_timestamp(F.col("p.a")).alias("valid_from"), F.to_timestamp(F.col("p.b")).alias("valid_to"))


def for_entity(rows: DataFrame, entity: str, ident: str = "id") -> DataFrame:
    """The records of one entity (or, by its column, of one document)."""
    return rows.filter(F.col(ident) == entity)


def between_for_entity(events: DataFrame, entity: str, start: str, end: str, at: str = "at", ident: str = "id") -> DataFrame:
    return between(for_entity(events, entity, ident), start, end, at)


def valid_at_for_entity(intervals: DataFrame, entity: str, when: str, ident: str = "id") -> DataFrame:
    return valid_at(for_entity(intervals, entity, ident), when)


def overlaps_for_entity(intervals: DataFrame, entity: str, start_at: str, end_at: str, ident: str = "id") -> DataFrame:
    return valid_overlaps(for_entity(intervals, entity, ident), start_at, end_at)


def access_path(bounds: dict, when: str) -> tuple[str, float]:
    """Whether a table ordered by start or one ordered by end has less to read for ``valid_at``, and the share of it.

    ``bounds`` is a row of ``stats``; times are taken as spread evenly, and open
    intervals are read in either order.
    """
    t = utc_micros(when)
    micros = lambda x: x if isinstance(x, int) else ((x if x.tzinfo else x.replace(tzinfo=timezone.utc)) - _EPOCH) // timedelta(microseconds=1)

    def below(lo, hi) -> float:
        if lo is None or hi is None:
            return 0.0
        a, b = micros(lo), micros(hi)
        return 1.0 if b <= a and t >= a else 0.0 if b <= a else min(max((t - a) / (b - a), 0.0), 1.0)

    total = max(bounds["total"], 1)
    open_ = bounds["open_ended"] / total
    by_start = below(bounds["min_start"], bounds["max_start"])
    by_end = open_ + (1 - open_) * (1 - below(bounds["min_end"], bounds["max_end"]))
    return ("start", by_start) if by_start <= by_end else ("end", by_end)


def ordered_by(intervals: DataFrame, path: str, order: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Writes intervals in files of ranges of their start or end, so that a scan by ``access_path`` skips files by their statistics."""
    by = {"start": start, "end": end}[order]
    intervals.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)
    return intervals.sparkSession.read.schema(intervals.schema).parquet(path)
