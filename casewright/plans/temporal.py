"""Temporal queries. A customer is a family of versions, an order a version, its status the lane (F law, O decree, P rule)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.operators import temporal as t

from .registry import query, table

LANES = {"law": "F", "decree": "O", "rule": "P"}
V = """v AS (SELECT o_custkey AS family, o_orderstatus AS lane, o_orderkey AS no, o_orderdate::DATE AS effective_at FROM orders),
w AS (SELECT *, lead(valid_from) OVER (PARTITION BY family, lane ORDER BY valid_from) AS valid_to FROM (SELECT family, lane, effective_at AS valid_from, max(no) AS no FROM v GROUP BY ALL))"""
SNAP = """s AS (SELECT l.family, l.no AS law_no, d.no AS decree_no, r.no AS rule_no, greatest(l.valid_from, d.valid_from, r.valid_from) AS valid_from,
  nullif(least(coalesce(l.valid_to, DATE '9999-12-31'), coalesce(d.valid_to, DATE '9999-12-31'), coalesce(r.valid_to, DATE '9999-12-31')), DATE '9999-12-31') AS valid_to
  FROM w l JOIN w d ON l.family = d.family JOIN w r ON l.family = r.family WHERE l.lane = 'F' AND d.lane = 'O' AND r.lane = 'P'),
snap AS (SELECT * FROM s WHERE valid_from < coalesce(valid_to, DATE '9999-12-31'))"""
DAY = "1998-06-30"


def versions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderstatus").alias("lane"), F.col("o_orderkey").alias("no"), F.col("o_orderdate").cast("date").alias("effective_at"))


def snapshots(spark, sf_dir):
    return t.change_points(versions(spark, sf_dir), "family", "lane", LANES)


def dated(df):
    """Dates as text, for comparison."""
    return df.select(*[F.col(c).cast("string").alias(c) if k == "date" else F.col(c) for c, k in df.dtypes])


@query(f"WITH {V} SELECT family, lane, no, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to FROM w")
def version_windows(spark, sf_dir):
    return dated(t.version_windows(versions(spark, sf_dir), ["family", "lane"]))


@query(f"WITH {V} SELECT family, lane, no, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to FROM w WHERE valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to > DATE '{DAY}')")
def effective_version_at(spark, sf_dir):
    return dated(t.effective_version(t.version_windows(versions(spark, sf_dir), ["family", "lane"]), ["family", "lane"], DAY))


_SNAP_SQL = f"WITH {V}, {SNAP} SELECT family, law_no, decree_no, rule_no, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to FROM snap"


@query(_SNAP_SQL)
def interval_overlap_3way(spark, sf_dir):
    w = t.version_windows(versions(spark, sf_dir), ["family", "lane"])
    return dated(t.overlap_join({n: w.filter(F.col("lane") == v) for n, v in LANES.items()}, "family"))


@query(_SNAP_SQL)
def interval_overlap_sweep(spark, sf_dir):
    return dated(snapshots(spark, sf_dir))


@query(f"""WITH {V}, {SNAP} SELECT family, law_no, decree_no, rule_no, valid_from::VARCHAR AS valid_from,
  (lead(valid_from) OVER (PARTITION BY family ORDER BY valid_from))::VARCHAR AS valid_to
  FROM (SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY family, law_no, decree_no, rule_no ORDER BY valid_from) = 1)""")
def change_point_snapshots(spark, sf_dir):
    return dated(t.first_of_set(snapshots(spark, sf_dir), "family", ["law_no", "decree_no", "rule_no"]))


@query(f"WITH {V}, {SNAP} SELECT family, law_no, decree_no, rule_no, valid_from::VARCHAR AS valid_from FROM snap WHERE valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to > DATE '{DAY}')")
def snapshot_by_date(spark, sf_dir):
    found = snapshots(spark, sf_dir).filter(t.covers(t.parse_date(F.lit(DAY.replace("-", ".")))))
    return dated(t.latest_per_group(found, ["family"], "valid_from").drop("valid_to"))


@query(f"WITH {V}, {SNAP} SELECT family, 'LAW_' || law_no || '__DECREE_' || decree_no || '__RULE_' || rule_no AS set_key, decree_no::VARCHAR AS decree_part, valid_from::VARCHAR AS valid_from FROM snap WHERE valid_to IS NULL")
def latest_open_snapshot(spark, sf_dir):
    s = t.latest_per_group(snapshots(spark, sf_dir).filter("valid_to is null"), ["family"], "valid_from")
    key = t.set_key({n.upper(): F.col(f"{n}_no").cast("string") for n in LANES})
    return dated(s.select("family", key.alias("set_key"), t.part_of_set_key(key, "DECREE").alias("decree_part"), "valid_from"))


@query(f"""WITH {V}, p AS (SELECT family, lane, effective_at, max(no) AS no FROM v GROUP BY ALL)
SELECT v.family, v.lane, v.no, v.effective_at::VARCHAR AS effective_at, q.effective_at::VARCHAR AS prior_at, q.no AS prior_no, CASE WHEN q.no IS NULL THEN 'no earlier version' END AS note
FROM v LEFT JOIN p q ON q.family = v.family AND q.lane = v.lane AND q.effective_at = (SELECT max(x.effective_at) FROM p x WHERE x.family = v.family AND x.lane = v.lane AND x.effective_at < v.effective_at)""")
def prior_version(spark, sf_dir):
    return dated(t.prior_version(versions(spark, sf_dir), ["family", "lane"]))


@query(f"""WITH {V}, a AS (SELECT o_orderkey AS ask, o_custkey AS family, o_orderdate::DATE - 400 AS day FROM orders WHERE o_orderstatus = 'P'),
l AS (SELECT family, effective_at, max(no) AS no FROM v WHERE lane = 'F' GROUP BY ALL),
m AS (SELECT a.ask, max(l.effective_at) FILTER (l.effective_at <= a.day) AS now, min(l.effective_at) AS old FROM a JOIN l USING (family) GROUP BY 1)
SELECT a.ask, a.family, a.day::VARCHAR AS day, coalesce(m.now, m.old)::VARCHAR AS version_at, l.no AS version_no, (m.now IS NULL AND m.old IS NOT NULL) AS fallback
FROM a LEFT JOIN m USING (ask) LEFT JOIN l ON l.family = a.family AND l.effective_at = coalesce(m.now, m.old)""")
def asof_with_fallback(spark, sf_dir):
    v = versions(spark, sf_dir)
    asks = v.filter("lane = 'P'").select(F.col("no").alias("ask"), "family", F.date_sub("effective_at", 400).alias("day"))
    return dated(t.asof_or_oldest(asks, v.filter("lane = 'F'"), "family", "day"))


@query(f"WITH {V} SELECT family, lane, no, effective_at::VARCHAR AS effective_at FROM v QUALIFY row_number() OVER (PARTITION BY family, lane ORDER BY effective_at DESC, no DESC) = 1")
def latest_per_group(spark, sf_dir):
    return dated(t.latest_per_group(versions(spark, sf_dir), ["family", "lane"], "effective_at", "no"))


@query(f"WITH {V} SELECT family, lane, no FROM v WHERE effective_at >= DATE '2000-01-01' EXCEPT SELECT family, lane, no FROM v WHERE no % 3 = 0")
def version_set_diff(spark, sf_dir):
    v = versions(spark, sf_dir)
    return t.new_ids(v.filter("effective_at >= date '2000-01-01'"), v.filter("no % 3 = 0"), ["family", "lane", "no"])


@query("""SELECT o_orderkey AS id, o_orderstatus AS status, 'old' AS origin FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'N', 'new' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0""")
def conditional_create(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    target = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit("old").alias("origin"))
    source = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("N").alias("status"), F.lit("new").alias("origin"))
    return t.append_unseen(target, source, ["id"])


@query("""SELECT o_orderkey AS case_id, (o_orderdate::DATE + 90)::DATE::VARCHAR AS deadline, (DATE '1998-09-01' - o_orderdate::DATE)::INTEGER AS elapsed,
(o_orderdate::DATE + 90) < DATE '1998-09-01' AS overdue, greatest(((o_orderdate::DATE + 90)::DATE - DATE '1998-09-01')::INTEGER, 0)::INTEGER AS left_days FROM orders WHERE o_orderstatus = 'O'""")
def appeal_deadlines(spark, sf_dir):
    cases = versions(spark, sf_dir).filter("lane = 'O'")
    return dated(t.deadlines(cases, "effective_at", "1998-09-01").select(F.col("no").alias("case_id"), "deadline", "elapsed", "overdue", F.col("left").alias("left_days")))


@query(f"""WITH {V} SELECT family, lane, listed, n FROM (SELECT family, lane, string_agg(no::VARCHAR, ',' ORDER BY effective_at DESC, no DESC) AS listed, count(*) AS n FROM v GROUP BY ALL)""")
def versions_newest_first(spark, sf_dir):
    v = versions(spark, sf_dir)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("effective_at", "no")), asc=False), lambda x: x["no"].cast("string")), ",")
    return v.groupBy("family", "lane").agg(listed.alias("listed"), F.count("*").alias("n"))


@query(f"WITH {V} SELECT family, no, effective_at::VARCHAR AS valid_from, (lead(effective_at) OVER (PARTITION BY family ORDER BY effective_at, no))::VARCHAR AS valid_to FROM v WHERE lane = 'F'")
def consecutive_intervals(spark, sf_dir):
    from pyspark.sql import Window

    v = versions(spark, sf_dir).filter("lane = 'F'")
    after = F.lead("effective_at").over(Window.partitionBy("family").orderBy("effective_at", "no"))
    return dated(v.select("family", "no", F.col("effective_at").alias("valid_from"), after.alias("valid_to")))
