"""Attribution within traces, deduplication and incremental merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.identity import is_session
from tracequarry.functions.text import UUID


def per_trace(spans: DataFrame, value: Column, *, last: bool, alias: str, order: str = "id") -> DataFrame:
    """(trace_id, alias): the last (or first) value that isn't null in each trace, by order. Aggregated before the shuffle, so a trace that holds most rows is one row a task."""
    pick = F.max_by if last else F.min_by
    return spans.filter(F.col("trace_id").isNotNull() & value.isNotNull()).groupBy("trace_id").agg(pick(value, F.col(order)).alias(alias))


def session_by_trace(spans: DataFrame, *, order: str = "id") -> DataFrame:
    """spans with session_id as their trace's last session id that isn't the trace id; rows without trace_id keep their own."""
    own = F.when(is_session(F.col("session_id")) & (F.col("session_id") != F.coalesce("trace_id", F.lit(""))), F.col("session_id"))
    t = per_trace(spans, own, last=True, alias="_session", order=order)
    return spans.join(t, "trace_id", "left").withColumn("session_id", F.coalesce("_session", "session_id")).drop("_session")


def session_by_trace_strict(spans: DataFrame, *, order: str = "id") -> DataFrame:
    """The narrower rule of query time: only UUIDs spread, and only onto rows whose session_id is their trace_id."""
    own = F.when(F.col("session_id").rlike(f"^{UUID}$") & (F.col("session_id") != F.coalesce("trace_id", F.lit(""))), F.col("session_id"))
    t = per_trace(spans, own, last=True, alias="_session", order=order)
    same = F.col("session_id") == F.col("trace_id")
    return spans.join(t, "trace_id", "left").withColumn("session_id", F.when(same, F.coalesce("_session", "session_id")).otherwise(F.col("session_id"))).drop("_session")


def users_by_trace(spans: DataFrame, *, order: str = "id") -> DataFrame:
    """spans with user_id and account_id as the first of their trace that isn't null; null if none is."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}")
    t = spans.filter("trace_id IS NOT NULL").groupBy("trace_id").agg(first("user_id"), first("account_id"))
    return spans.join(t, "trace_id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("user_id", "account_id")}).drop("_user_id", "_account_id")


def keep_last(df: DataFrame, keys: Sequence[str], *, order: str = "id", keep_null_keys: bool = False) -> DataFrame:
    """One row for each key, the last by order; null keys are equal to each other, or all kept. Row and order are picked by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    some_null = F.lit(False)
    for k in keys:
        some_null = some_null | F.col(k).isNull()
    once = df.filter(~some_null) if keep_null_keys else df
    out = once.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)
    return out.unionByName(df.filter(some_null)) if keep_null_keys else out


def keep_first(df: DataFrame, keys: Sequence[str], *, order: str = "id") -> DataFrame:
    """One row for each key, the first by order; rows with a null key are dropped."""
    rest = [c for c in df.columns if c not in keys]
    out = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return out.select(*keys, "_r.*").select(*df.columns)


def unify(existing: DataFrame, new: DataFrame, *, key: str = "span_id", order: str = "id") -> DataFrame:
    """Both frames by column name, missing columns null, one row a key; a new row wins over an existing one."""
    a = existing.withColumn("_src", F.lit(0))
    b = new.withColumn("_src", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_o", F.struct("_src", order))
    return keep_last(both, [key], order="_o").drop("_src", "_o")


def unify_report(existing: DataFrame, new: DataFrame, *, key: str = "span_id") -> DataFrame:
    """One row: sessions new and continued, rows before, new, duplicates removed and after."""
    both = existing.select(key, "session_id", F.lit(0).alias("s")).unionByName(new.select(key, "session_id", F.lit(1).alias("s")))
    by_session = both.filter("session_id IS NOT NULL").groupBy("session_id").agg(F.bool_or(F.col("s") == 0).alias("old"), F.bool_or(F.col("s") == 1).alias("new"))
    one = by_session.agg(F.count_if(F.col("new") & ~F.col("old")).alias("new_sessions"), F.count_if(F.col("new") & F.col("old")).alias("continued_sessions"))
    rows = both.groupBy(key).agg(F.count_if(F.col("s") == 0).alias("o"), F.count_if(F.col("s") == 1).alias("n"))
    two = rows.agg(F.sum("o").alias("spans_before"), F.sum("n").alias("spans_new"), (F.sum("o") + F.sum("n") - F.count("*")).alias("duplicates_removed"), F.count("*").alias("spans_after"))
    return one.join(F.broadcast(two))


def only_new(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key existing doesn't have; null keys count as new."""
    return new.join(existing.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, *, first: Sequence[str] = (), last: Sequence[str] = (), unions: Sequence[str] = ()) -> DataFrame:
    """Merge by key: new values where they aren't null, the lesser of columns in first, the greater of those in last, the union of arrays in unions."""
    o = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in old.columns if c != key))
    n = new.select(key, *(F.col(c).alias(f"_n_{c}") for c in new.columns if c != key))

    def pick(c: str) -> Column:
        a, b = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in first:
            return F.least(a, b)
        if c in last:
            return F.greatest(a, b)
        if c in unions:
            return F.array_sort(F.array_union(F.coalesce(a, F.expr("CAST(array() AS array<string>)")), F.coalesce(b, F.expr("CAST(array() AS array<string>)"))))
        return F.coalesce(b, a)

    return o.join(n, key, "full").select(key, *(pick(c).alias(c) for c in old.columns if c != key))


def with_identity(df: DataFrame, people: DataFrame, *, key: str = "account_id") -> DataFrame:
    """df with person and label: the person's e-mail, '(unattributed)' without an id, '(unclaimed:xxxxxxxx)' for unknown ids. An id claimed by two persons is nobody's."""
    norm = lambda c: F.lower(F.trim(c))
    p = people.filter(F.col(key).isNotNull()).groupBy(norm(F.col(key)).alias("_k")).agg(F.count_distinct("person_name").alias("n"), F.min("person_name").alias("person_name"), F.min("email").alias("email")).filter("n = 1").drop("n")
    if people.limit(100_001).count() <= 100_000:
        p = F.broadcast(p)
    k = norm(F.col(key))
    label = F.when(F.coalesce(k, F.lit("")) == "", "(unattributed)").when(F.col("person_name").isNull(), F.concat(F.lit("(unclaimed:"), F.substring(k, 1, 8), F.lit(")"))).otherwise(F.coalesce("email", "person_name"))
    return df.join(p, k == F.col("_k"), "left").withColumn("person", F.col("person_name")).withColumn("label", label).drop("_k", "person_name", "email")
