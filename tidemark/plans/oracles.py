"""Reference SQL for every query, over the same star-schema tables (DuckDB dialect)."""

from __future__ import annotations

from tidemark.schema import TRACKED_FIELDS

_NOW = "TIMESTAMP '2001-08-01 06:00:00'"

# The derived history. `done` are the completed runs, `cur` and `prev` the rows of the two newest.
_HISTORY = """
WITH runs AS (
  SELECT CAST(i AS INTEGER) AS id,
         TIMESTAMP '2000-09-01 00:00:00' + to_months(CAST(i - 1 AS INTEGER)) AS started_at,
         CASE WHEN i = 6 THEN 'failed' ELSE 'completed' END AS status
  FROM range(1, 13) AS t(i)
),
entities AS (
  SELECT c.*, n_name,
         TIMESTAMP '2000-01-03 00:00:00' + to_days(CAST(c_custkey * 7 % 577 AS INTEGER))
           + to_hours(CAST(c_custkey % 24 AS INTEGER)) AS created
  FROM customer c LEFT JOIN nation ON c_nationkey = n_nationkey
),
figures AS (
  SELECT id AS scrape_run_id, o_custkey, any_value(started_at) AS started_at,
         count(*) AS orders,
         SUM(CAST(floor(o_totalprice / 1000) AS BIGINT)) AS thousands,
         SUM(CAST(floor(o_totalprice / 5000) AS BIGINT)) AS installs,
         SUM(CAST(floor(o_totalprice / 5000) AS BIGINT))
           FILTER (WHERE o_orderdate >= started_at - INTERVAL 180 DAY) AS installs_recent,
         count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS urgent,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS pending,
         max({'d': o_orderdate, 'k': o_orderkey, 'p': o_orderpriority}) AS newest
  FROM runs JOIN orders ON o_orderdate < started_at
  GROUP BY id, o_custkey
  HAVING count(*) FILTER (WHERE o_orderdate >= started_at - INTERVAL 180 DAY) > 0
),
snapshots AS (
  SELECT scrape_run_id, 'C' || c_custkey AS skill_id,
         CASE WHEN c_custkey % 97 <> 0 THEN lower(replace(c_name, '#', '-')) END AS slug,
         c_name AS display_name, c_mktsegment AS summary,
         CASE WHEN c_custkey % 89 <> 0 THEN created END AS created_at,
         newest.d AS updated_at,
         CAST(thousands AS BIGINT) AS stat_downloads,
         CAST(urgent AS BIGINT) AS stat_stars,
         CAST(pending AS BIGINT) AS stat_comments,
         CAST(installs AS BIGINT) AS stat_installs_all_time,
         CAST(installs_recent AS BIGINT) AS stat_installs_current,
         CAST(orders AS BIGINT) AS stat_versions,
         CASE WHEN c_custkey % 101 <> 0 THEN n_name END AS owner_handle,
         newest.p AS version_number,
         'order ' || newest.k AS version_changelog,
         CAST(NULL AS VARCHAR) AS version_id
  FROM figures JOIN entities ON c_custkey = o_custkey AND created < started_at
),
done AS (SELECT id AS scrape_run_id, started_at FROM runs WHERE status = 'completed'),
ranked AS (
  SELECT *, CAST(row_number() OVER (ORDER BY scrape_run_id DESC) AS INTEGER) AS run_rank FROM done
),
cur AS (
  SELECT s.*, r.started_at FROM snapshots s JOIN ranked r USING (scrape_run_id) WHERE run_rank = 1
),
prev AS (
  SELECT s.*, r.started_at FROM snapshots s JOIN ranked r USING (scrape_run_id) WHERE run_rank = 2
)
"""


_DAYS = f"date_diff('day', created_at, {_NOW})"
_DAYS_OLD = f"CAST({_DAYS} AS INTEGER) AS days_old"
_RATE = f"(stat_downloads / greatest({_DAYS}, 1))"
_LISTED = "skill_id, slug, display_name, owner_handle"


def _rank(order: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank"


def _top(columns: str, source: str, order: str, k: int) -> str:
    """The first k rows, numbered."""
    return f"SELECT {_rank(order)}, {columns} FROM {source} QUALIFY rank <= {k}"


_RUN_TOTALS = """
  SELECT scrape_run_id, d.started_at, count(*) AS total_skills,
         CAST(SUM(stat_downloads) AS BIGINT) AS total_downloads,
         CAST(SUM(stat_stars) AS BIGINT) AS total_stars
  FROM snapshots s JOIN done d USING (scrape_run_id) GROUP BY ALL
"""

_WEEKS = """
  SELECT CAST(date_trunc('week', created_at) AS TIMESTAMP) AS week_start, count(*) AS new_count
  FROM cur WHERE created_at IS NOT NULL GROUP BY 1
"""

_WEEKLY_GROWTH = f"""
  SELECT week_start, new_count, CAST(cumulative AS BIGINT) AS cumulative,
         CASE WHEN before > 0 THEN round((effective - before) / before * 100, 1) END AS wow_pct,
         is_forecast,
         CASE WHEN is_forecast THEN effective END AS forecast_count
  FROM (
    SELECT *, lag(effective) OVER (ORDER BY week_start) AS before,
           SUM(new_count) OVER (ORDER BY week_start ROWS UNBOUNDED PRECEDING) AS cumulative,
           row_number() OVER (ORDER BY week_start DESC) AS age
    FROM (
      SELECT *, CASE WHEN is_forecast
                     THEN CAST(round_even(new_count / elapsed * 7, 0) AS BIGINT)
                     ELSE new_count END AS effective
      FROM (
        SELECT *, week_start >= date_trunc('week', {_NOW}) AND elapsed BETWEEN 1 AND 6
                  AS is_forecast
        FROM (SELECT *, date_diff('day', week_start, {_NOW}) + 1 AS elapsed FROM ({_WEEKS}))
      )
    )
  )
  WHERE age <= 12
"""

# Download steps between consecutive rows of an entity within a group of three runs.
_VELOCITY = """
  SELECT skill_id, avg(step) FILTER (WHERE recent) AS velocity_recent,
         avg(step) FILTER (WHERE NOT recent) AS velocity_prior
  FROM (
    SELECT skill_id, run_rank <= 3 AS recent,
           stat_downloads - lag(stat_downloads)
             OVER (PARTITION BY skill_id, run_rank <= 3 ORDER BY scrape_run_id) AS step
    FROM snapshots JOIN ranked USING (scrape_run_id) WHERE run_rank <= 6
  ) GROUP BY skill_id
"""
_ACCEL = """CASE WHEN velocity_prior > 0
  THEN round((velocity_recent - velocity_prior) / velocity_prior * 100, 1) END"""
_TREND = """CASE
  WHEN velocity_prior = 0 OR velocity_prior IS NULL OR velocity_recent IS NULL THEN 'flat'
  WHEN (velocity_recent - velocity_prior) / abs(velocity_prior) * 100 > 5 THEN 'up'
  WHEN (velocity_recent - velocity_prior) / abs(velocity_prior) * 100 < -5 THEN 'down'
  ELSE 'flat' END"""

_CHARTS = """
  SELECT skill_id, string_agg(CAST(stat_downloads AS VARCHAR), ',' ORDER BY scrape_run_id)
         AS velocity_chart
  FROM snapshots JOIN ranked USING (scrape_run_id) WHERE run_rank <= 10 GROUP BY skill_id
"""

_DELTAS = """
  SELECT c.*, p.stat_downloads AS before,
         c.stat_downloads - coalesce(p.stat_downloads, 0) AS delta
  FROM cur c LEFT JOIN prev p USING (skill_id)
"""

_RISING = f"""
  SELECT rank, skill_id, slug, display_name, owner_handle, summary, created_at, {_DAYS_OLD},
         stat_downloads, delta,
         CASE WHEN before > 0 THEN round(100.0 * delta / before, 1) END AS delta_pct,
         round({_RATE}, 1) AS dl_per_day, velocity_chart
  FROM ({_top("*", f"(SELECT * FROM ({_DELTAS}) WHERE delta > 0)", "delta DESC, skill_id", 50)})
  JOIN ({_CHARTS}) USING (skill_id)
"""

_CHANGED = f"""
  SELECT c.skill_id, c.slug, c.display_name,
         {", ".join(f"p.{f} AS prev_{f}, c.{f} AS curr_{f}" for f in TRACKED_FIELDS)}
  FROM cur c JOIN prev p USING (skill_id)
  WHERE {" OR ".join(f"c.{f} IS DISTINCT FROM p.{f}" for f in TRACKED_FIELDS)}
"""

_CHANGES_LONG = " UNION ALL ".join(
    f"SELECT skill_id, '{f}' AS field, CAST(prev_{f} AS VARCHAR) AS from_value, "
    f"CAST(curr_{f} AS VARCHAR) AS to_value FROM ({_CHANGED}) "
    f"WHERE prev_{f} IS DISTINCT FROM curr_{f}"
    for f in TRACKED_FIELDS
)


def _only_in(left: str, right: str) -> str:
    return f"SELECT {_LISTED}, stat_downloads FROM {left} ANTI JOIN {right} USING (skill_id)"


_DIFF_ALL = f"""
  SELECT r.scrape_run_id, r.run_before AS previous_run_id,
         count(p.skill_id) AS previous_skills, count(c.skill_id) AS total_skills,
         count(*) FILTER (WHERE run_before IS NOT NULL AND p.skill_id IS NULL) AS new_skills,
         count(*) FILTER (WHERE c.skill_id IS NULL) AS removed_skills,
         count(*) FILTER (WHERE p.skill_id IS NOT NULL AND c.skill_id IS NOT NULL AND (
           {" OR ".join(f"c.{f} IS DISTINCT FROM p.{f}" for f in TRACKED_FIELDS)})) AS changed_skills
  FROM (
    SELECT scrape_run_id, lag(scrape_run_id) OVER (ORDER BY scrape_run_id) AS run_before FROM done
  ) r
  JOIN (
    SELECT DISTINCT scrape_run_id AS run, skill_id FROM snapshots
    UNION
    SELECT n.scrape_run_id, skill_id FROM snapshots s JOIN (
      SELECT scrape_run_id, lag(scrape_run_id) OVER (ORDER BY scrape_run_id) AS run_before FROM done
    ) n ON s.scrape_run_id = n.run_before
  ) k ON k.run = r.scrape_run_id
  LEFT JOIN snapshots c ON c.scrape_run_id = r.scrape_run_id AND c.skill_id = k.skill_id
  LEFT JOIN snapshots p ON p.scrape_run_id = r.run_before AND p.skill_id = k.skill_id
  GROUP BY ALL
"""

# Every completed run with the one before it, and the rows of both.
_STEPS = """(
  SELECT * FROM (
    SELECT scrape_run_id AS run, lag(scrape_run_id) OVER (ORDER BY scrape_run_id) AS before FROM done
  ) WHERE before IS NOT NULL)"""


def _feed_rows(kind: str, joined: str, changes: str) -> str:
    row = "p" if kind == "removed" else "c"
    columns = ", ".join(
        f"{row}.{c}" for c in ("skill_id", "slug", "display_name", "owner_handle", "stat_downloads")
    )
    return f"""
      SELECT '{kind}' AS kind, {columns}, CAST({changes} AS INTEGER) AS changes,
             before AS previous_run_id, run AS scrape_run_id FROM {_STEPS} {joined}"""


_DIFFERING = " + ".join(f"CAST(c.{f} IS DISTINCT FROM p.{f} AS INTEGER)" for f in TRACKED_FIELDS)
_CHANGE_FEED = " UNION ALL ".join([
    _feed_rows("new", """JOIN snapshots c ON c.scrape_run_id = run
      LEFT JOIN snapshots p ON p.scrape_run_id = before AND p.skill_id = c.skill_id
      WHERE p.skill_id IS NULL""", "NULL"),
    _feed_rows("removed", """JOIN snapshots p ON p.scrape_run_id = before
      LEFT JOIN snapshots c ON c.scrape_run_id = run AND p.skill_id = c.skill_id
      WHERE c.skill_id IS NULL""", "NULL"),
    _feed_rows("changed", f"""JOIN snapshots c ON c.scrape_run_id = run
      JOIN snapshots p ON p.scrape_run_id = before AND p.skill_id = c.skill_id
      WHERE {_DIFFERING} > 0""", _DIFFERING),
])
_FEED_LONG = " UNION ALL ".join(
    f"SELECT run AS scrape_run_id, c.skill_id, '{f}' AS field, CAST(p.{f} AS VARCHAR) AS from_value,"
    f" CAST(c.{f} AS VARCHAR) AS to_value FROM {_STEPS} JOIN snapshots c ON c.scrape_run_id = run"
    f" JOIN snapshots p ON p.scrape_run_id = before AND p.skill_id = c.skill_id"
    f" WHERE c.{f} IS DISTINCT FROM p.{f}"
    for f in TRACKED_FIELDS
)

_OWNER_TOTALS = """
  SELECT owner_handle, count(*) AS skill_count,
         CAST(SUM(stat_downloads) AS BIGINT) AS total_downloads,
         CAST(SUM(stat_stars) AS BIGINT) AS total_stars
  FROM cur WHERE owner_handle IS NOT NULL GROUP BY owner_handle
"""

_OWNER_STATS = f"""
  SELECT owner_handle, skill_count, total_downloads, total_stars,
         round(total_downloads / SUM(total_downloads) OVER () * 100, 2) AS dl_pct,
         round(total_stars / SUM(total_stars) OVER () * 100, 2) AS star_pct,
         round(rate, 1) AS avg_dl_per_day, first_skill_at
  FROM (
    SELECT owner_handle, count(*) AS skill_count,
           CAST(SUM(stat_downloads) AS BIGINT) AS total_downloads,
           CAST(SUM(stat_stars) AS BIGINT) AS total_stars,
           avg({_RATE}) AS rate, min(created_at) AS first_skill_at
    FROM cur WHERE owner_handle IS NOT NULL AND created_at IS NOT NULL GROUP BY owner_handle
  )
"""


def _owners_by(key: str) -> str:
    return _top("*", f"({_OWNER_STATS})", f"{key} DESC, total_downloads DESC, owner_handle", 50)


_DETAIL_KEYS = f"""
  SELECT slug FROM ({_top("slug", "(SELECT * FROM cur WHERE slug IS NOT NULL)",
                          "stat_downloads DESC, skill_id", 200)})
  UNION
  SELECT slug FROM ({_top("slug", "(SELECT * FROM cur WHERE slug IS NOT NULL"
                          " AND created_at IS NOT NULL)", f"{_RATE} DESC, skill_id", 50)})
"""

_DETAIL_OWNERS = f"""
  SELECT rank, owner_handle, regexp_replace(lower(owner_handle), '[^a-z0-9_-]', '-', 'g') AS owner_key
  FROM ({_top("*", f"({_OWNER_TOTALS})", "total_downloads DESC, owner_handle", 50)})
"""

_RELEASES = """
  SELECT skill_id, scrape_run_id, started_at AS run_date, version_number,
         version_changelog AS changelog
  FROM (
    SELECT s.*, d.started_at,
           lag(version_number) OVER (PARTITION BY skill_id ORDER BY scrape_run_id) AS before
    FROM snapshots s JOIN done d USING (scrape_run_id)
  ) WHERE version_number <> '' AND version_number <> before
"""

_TRAJECTORY = """
  SELECT owner_handle, scrape_run_id, d.started_at AS run_date,
         CAST(SUM(stat_downloads) AS BIGINT) AS downloads, CAST(SUM(stat_stars) AS BIGINT) AS stars
  FROM snapshots JOIN done d USING (scrape_run_id) WHERE owner_handle IS NOT NULL GROUP BY ALL
"""

_PORTFOLIO = f"""
  SELECT owner_handle,
         CAST(coalesce(SUM(stat_downloads) FILTER (WHERE dated), 0) AS BIGINT) AS total_downloads,
         CAST(coalesce(SUM(stat_stars) FILTER (WHERE dated), 0) AS BIGINT) AS total_stars,
         CAST(coalesce(SUM(stat_installs_all_time) FILTER (WHERE dated), 0) AS BIGINT)
           AS total_installs,
         count(*) FILTER (WHERE dated) AS skill_count,
         coalesce(round(avg({_RATE}) FILTER (WHERE dated), 1), 0) AS avg_dl_per_day
  FROM (SELECT *, created_at IS NOT NULL AS dated FROM cur) WHERE owner_handle IS NOT NULL
  GROUP BY owner_handle
"""

_OWNER_ENTITIES = f"""
  SELECT owner_handle, skill_id, slug, display_name, stat_downloads, stat_stars, created_at,
         {_DAYS_OLD}
  FROM cur WHERE owner_handle IS NOT NULL
"""

_FASTEST = f"""
  SELECT {_rank("acceleration_pct DESC, stat_downloads DESC, skill_id")}, *
  FROM (
    SELECT {_LISTED}, stat_downloads, stat_stars, created_at, {_DAYS_OLD},
           CASE WHEN velocity_recent <> 0 THEN round(velocity_recent, 1) END AS velocity,
           {_ACCEL} AS acceleration_pct, {_TREND} AS trend
    FROM cur JOIN ({_VELOCITY}) USING (skill_id) WHERE stat_downloads >= 1000
  ) WHERE acceleration_pct IS NOT NULL QUALIFY rank <= 100
"""

_ALL_TIME = f"""
  SELECT rank, {_LISTED}, stat_downloads, stat_stars, created_at, {_DAYS_OLD},
         round(velocity_recent, 1) AS velocity, {_TREND} AS trend
  FROM ({_top("*", "cur", "stat_downloads DESC, skill_id", 100)})
  LEFT JOIN ({_VELOCITY}) USING (skill_id)
"""

_TOP_SHARE = """
  SELECT n AS total_skills, total AS total_downloads, top1 AS top1_downloads,
         top10 AS top10_downloads, round(top1 / total * 100, 2) AS top1_pct,
         round(top10 / total * 100, 2) AS top10_pct
  FROM (
    SELECT count(*) AS n, CAST(SUM(stat_downloads) AS BIGINT) AS total,
           CAST(SUM(stat_downloads) FILTER (WHERE t100 = 1) AS BIGINT) AS top1,
           CAST(SUM(stat_downloads) FILTER (WHERE t10 = 1) AS BIGINT) AS top10
    FROM (
      SELECT stat_downloads, ntile(100) OVER (ORDER BY stat_downloads DESC) AS t100,
             ntile(10) OVER (ORDER BY stat_downloads DESC) AS t10
      FROM cur
    )
  )
"""

_GROWTH_TIMELINE = f"""
  SELECT week_start, new_count,
         CAST(SUM(new_count) OVER (ORDER BY week_start ROWS UNBOUNDED PRECEDING) AS BIGINT)
           AS cumulative,
         round_even((new_count - lag(new_count) OVER (ORDER BY week_start))
           / lag(new_count) OVER (ORDER BY week_start) * 100, 0) AS wow_pct
  FROM ({_WEEKS})
"""

_COHORT_QUALITY = f"""
  SELECT CAST(date_trunc('month', created_at) AS TIMESTAMP) AS cohort_month,
         count(*) AS skill_count, round(avg(stat_downloads), 0) AS avg_downloads,
         round(avg(stat_stars), 1) AS avg_stars,
         round(CASE WHEN SUM(stat_downloads) > 0 THEN
           CAST(SUM(stat_installs_all_time) AS DOUBLE) * 100 / SUM(stat_downloads) ELSE 0 END, 1)
           AS install_pct,
         round(avg({_RATE}), 1) AS avg_dl_per_day
  FROM cur WHERE created_at IS NOT NULL GROUP BY 1
"""

_PLATFORM_VELOCITY = f"""
  SELECT *, total_downloads - lag(total_downloads) OVER (ORDER BY scrape_run_id)
           AS download_delta,
         round((total_downloads - lag(total_downloads) OVER (ORDER BY scrape_run_id))
           / greatest(epoch(started_at - lag(started_at) OVER (ORDER BY scrape_run_id)) / 86400,
                      0.01), 2) AS downloads_per_day
  FROM ({_RUN_TOTALS})
"""

_AVG_PLATFORM_VELOCITY = f"""
  SELECT n_runs, round(days, 1) AS total_days, round(growth / days, 2) AS avg_downloads_per_day
  FROM (
    SELECT count(*) AS n_runs,
           greatest(epoch(max(started_at) - min(started_at)) / 86400, 0.01) AS days,
           arg_max(total_downloads, scrape_run_id) - arg_min(total_downloads, scrape_run_id)
             AS growth
    FROM ({_RUN_TOTALS})
  ) WHERE n_runs >= 3
"""

_RISING_RECENT = f"""
  SELECT rank, skill_id, display_name, owner_handle, stat_downloads AS curr_downloads,
         coalesce(before, 0) AS prev_downloads, delta, stat_stars, created_at,
         (SELECT round(epoch(max(started_at) - min(started_at)) / 3600, 1) FROM ranked
          WHERE run_rank <= 2) AS hours
  FROM ({_top("*", f"(SELECT * FROM ({_DELTAS}) WHERE created_at >= started_at - INTERVAL 14 DAY)",
              "delta DESC, skill_id", 15)})
"""

_DIFF_COUNTS = f"""
  SELECT scrape_run_id AS current_run_id, previous_run_id, previous_skills, total_skills,
         new_skills, removed_skills, changed_skills
  FROM ({_DIFF_ALL}) WHERE scrape_run_id = (SELECT max(scrape_run_id) FROM done)
"""


def _diff_list(section: str, source: str, extra: str) -> str:
    top = _top("*", f"({source})", "stat_downloads DESC, skill_id", 10)
    return f"""
      SELECT '{section}' AS section, rank, skill_id,
             coalesce(nullif(display_name, ''), slug) AS label, owner_handle, {extra} AS n_changes
      FROM ({top})"""


_DIFF_SUMMARY = " UNION ALL ".join([
    _diff_list("new", _only_in("cur", "prev"), "CAST(NULL AS INTEGER)"),
    _diff_list("removed", _only_in("prev", "cur"), "CAST(NULL AS INTEGER)"),
    _diff_list(
        "changed",
        f"SELECT *, curr_stat_downloads AS stat_downloads, curr_owner_handle AS owner_handle "
        f"FROM ({_CHANGED})",
        " + ".join(f"CAST(prev_{f} IS DISTINCT FROM curr_{f} AS INTEGER)" for f in TRACKED_FIELDS),
    ),
])

_HOT_NEW = _top(
    "skill_id, display_name, owner_handle, stat_downloads, stat_stars, stat_installs_all_time, "
    "created_at",
    f"(SELECT * FROM cur WHERE created_at >= {_NOW} - INTERVAL 30 DAY)",
    "stat_downloads DESC, skill_id",
    10,
)

_TOP_COLUMNS = f"{_LISTED}, stat_downloads, stat_stars, stat_installs_all_time, stat_versions"

_STAR_RATE = _top(
    "skill_id, display_name, owner_handle, stat_downloads, stat_stars, "
    "round(stat_stars * 100.0 / stat_downloads, 2) AS rate",
    "(SELECT * FROM cur WHERE stat_downloads >= 1000)",
    "stat_stars / stat_downloads DESC, skill_id",
    10,
)

_MOST_VERSIONS = _top(
    "skill_id, display_name, owner_handle, stat_versions, stat_downloads",
    "cur",
    "stat_versions DESC, skill_id",
    10,
)

_SPAM = """
  SELECT owner_handle, count(*) AS skill_count, round(avg(stat_downloads), 0) AS avg_downloads
  FROM cur WHERE owner_handle IS NOT NULL GROUP BY owner_handle
  HAVING count(*) > 30 AND avg(stat_downloads) < 2600
"""

_TOTALS = """
  SELECT count(*) AS total_skills,
         CAST(coalesce(SUM(stat_downloads), 0) AS BIGINT) AS total_downloads,
         CAST(coalesce(SUM(stat_stars), 0) AS BIGINT) AS total_stars,
         CAST(coalesce(SUM(stat_comments), 0) AS BIGINT) AS total_comments,
         CAST(coalesce(SUM(stat_installs_all_time), 0) AS BIGINT) AS total_installs,
         count(DISTINCT owner_handle) AS unique_owners
  FROM cur
"""

# Report tables in order; those marked are left out when empty.
_REPORT = [
    ("platform_totals", _TOTALS, False),
    ("top_share", _TOP_SHARE, False),
    ("growth_timeline", _GROWTH_TIMELINE, False),
    ("cohort_quality", _COHORT_QUALITY, False),
    ("hot_new", _HOT_NEW, False),
    ("top_by_downloads", _top("skill_id", "cur", "stat_downloads DESC, skill_id", 10), False),
    ("star_rate", _STAR_RATE, False),
    ("most_versions", _MOST_VERSIONS, False),
    ("owner_leaderboard", f"SELECT * FROM ({_OWNER_TOTALS}) LIMIT 10", False),
    ("owner_spam", _SPAM, True),
    ("platform_velocity", _PLATFORM_VELOCITY, True),
    ("avg_platform_velocity", _AVG_PLATFORM_VELOCITY, True),
    ("rising_recent", _RISING_RECENT, True),
    ("diff_counts", _DIFF_COUNTS, True),
    ("diff_summary", _DIFF_SUMMARY, True),
]

_HANDLES = """
  SELECT owner_handle, regexp_replace(lower(owner_handle), '[^a-z0-9_-]', '-', 'g') AS owner_key
  FROM (SELECT c_name AS owner_handle FROM customer
        UNION SELECT lower(replace(c_name, '#', '-')) FROM customer)
"""


def _page_list(page: str, section: str, position: str, key: str, value: str, source: str) -> str:
    return f"""SELECT '{page}' AS page, '{section}' AS section,
      CAST({position} AS INTEGER) AS position, CAST({key} AS VARCHAR) AS key,
      CAST({value} AS BIGINT) AS value FROM ({source})"""


# All runs are loaded together: the clock is asked at the start and at the end, 90 seconds later. A
# run without items lands besides those of the history.
_RUN_LOG = f"""
      SELECT r.id, {_NOW} AS started_at, {_NOW} + INTERVAL 90 SECOND AS finished_at,
             CAST(coalesce(total_skills, 0) AS INTEGER) AS total_skills,
             r.status, CAST(90 AS DOUBLE) AS duration_secs,
             CAST(coalesce(new_skills, 0) AS INTEGER) AS new_skills,
             CAST(coalesce(CASE WHEN previous_run_id IS NOT NULL THEN removed_skills END, 0)
               AS INTEGER) AS removed_skills,
             CAST(coalesce(changed_skills, 0) AS INTEGER) AS changed_skills
      FROM (SELECT id, status FROM runs UNION ALL SELECT CAST(13 AS INTEGER), 'failed') r
      LEFT JOIN ({_DIFF_ALL}) d ON d.scrape_run_id = r.id"""

_BY_RUN = "row_number() OVER (ORDER BY scrape_run_id)"
_PAGE_LISTS = " UNION ALL ".join([
    _page_list(
        "dashboard",
        "weekly_growth",
        "row_number() OVER (ORDER BY week_start)",
        "strftime(week_start, '%Y-%m-%dT%H:%M:%S.000')",
        "cumulative",
        _WEEKLY_GROWTH,
    ),
    _page_list("dashboard", "download_sparkline", _BY_RUN, "NULL", "total_downloads", _RUN_TOTALS),
    _page_list(
        "dashboard",
        "download_percentiles",
        _BY_RUN,
        "strftime(started_at, '%Y-%m-%d')",
        "total_skills",
        _RUN_TOTALS,
    ),
    _page_list("rising", "skills", "rank", "skill_id", "delta", _RISING),
    _page_list("leaderboard", "all_time", "rank", "skill_id", "stat_downloads", _ALL_TIME),
    _page_list("leaderboard", "fastest_growing", "rank", "skill_id", "stat_downloads", _FASTEST),
    _page_list(
        "owners",
        "by_downloads",
        "rank",
        "owner_handle",
        "total_downloads",
        _owners_by("total_downloads"),
    ),
    _page_list(
        "owners", "by_stars", "rank", "owner_handle", "total_stars", _owners_by("total_stars")
    ),
    _page_list(
        "owners", "by_skill_count", "rank", "owner_handle", "skill_count", _owners_by("skill_count")
    ),
])

_DETAILED = f"(SELECT skill_id, slug FROM cur WHERE slug IN ({_DETAIL_KEYS}))"

_PERCENTILES = ", ".join(
    f"round_even(quantile_cont(stat_downloads, 0.{p}), 0) AS p{p}" for p in (50, 90, 95, 99)
)
_RATE_PERCENTILES = ", ".join(
    f"round(quantile_cont({_RATE}, 0.{p}), 1) AS p{p}" for p in (10, 25, 50, 75, 90, 99)
)

_SNAPSHOT_COLUMNS = f"{_LISTED}, stat_downloads, created_at"

_OVER_HISTORY = {
    "latest_completed_run": "SELECT max(scrape_run_id) AS latest_run_id FROM done",
    "run_by_id": f"SELECT * FROM ({_RUN_LOG}) WHERE id = 7",
    "snapshot_count": """
      SELECT r.id AS scrape_run_id, status, count(skill_id) AS snapshot_count
      FROM runs r LEFT JOIN snapshots s ON s.scrape_run_id = r.id GROUP BY ALL""",
    "last_runs": """
      SELECT scrape_run_id, TIMESTAMP '2001-08-01 06:00:00' AS started_at, run_rank,
             CASE WHEN run_rank <= 3 THEN 'recent' ELSE 'prior' END AS bucket
      FROM ranked WHERE run_rank <= 6""",
    "current_entities": f"SELECT {_SNAPSHOT_COLUMNS} FROM cur",
    "previous_entities": f"SELECT {_SNAPSHOT_COLUMNS} FROM prev",
    "top_by_downloads": _top(_TOP_COLUMNS, "cur", "stat_downloads DESC, skill_id", 20),
    "top_by_stars": _top(
        f"{_LISTED}, stat_stars, stat_downloads", "cur", "stat_stars DESC, skill_id", 20
    ),
    "most_versions": _MOST_VERSIONS,
    "star_rate": _STAR_RATE,
    "hot_new": _HOT_NEW,
    "download_growth": _top(
        f"{_LISTED}, prev_downloads, curr_downloads, growth",
        """(SELECT c.*, p.stat_downloads AS prev_downloads, c.stat_downloads AS curr_downloads,
                   c.stat_downloads - p.stat_downloads AS growth
            FROM cur c JOIN prev p USING (skill_id) WHERE c.stat_downloads > p.stat_downloads)""",
        "growth DESC, skill_id",
        20,
    ),
    "rising": _RISING,
    "rising_by_pct": f"""
      SELECT {_rank("coalesce(delta_pct, 0) DESC, delta_rank")}, *
      FROM (SELECT rank AS delta_rank, skill_id, slug, stat_downloads, delta, delta_pct
            FROM ({_RISING}))""",
    "rising_recent": _RISING_RECENT,
    "rising_by_rate": f"""
      SELECT rank, {_LISTED}, summary, created_at, {_DAYS_OLD}, stat_downloads, delta,
             round({_RATE}, 1) AS dl_per_day, velocity_chart
      FROM ({_top("*",
                  f"(SELECT * FROM ({_DELTAS}) WHERE created_at >= {_NOW} - INTERVAL 30 DAY)",
                  f"{_RATE} DESC, skill_id", 50)})
      JOIN ({_CHARTS}) USING (skill_id)""",
    "detail_keys": _DETAIL_KEYS,
    "diff_new": _only_in("cur", "prev"),
    "diff_removed": _only_in("prev", "cur"),
    "diff_changed": _CHANGED,
    "diff_changes_long": _CHANGES_LONG,
    "diff_counts": _DIFF_COUNTS,
    "diff_summary": _DIFF_SUMMARY,
    "diff_all_runs": _DIFF_ALL,
    "diff_pair": f"""
      SELECT count(*) FILTER (WHERE p.skill_id IS NULL) AS new_skills,
             count(*) FILTER (WHERE c.skill_id IS NULL) AS removed_skills,
             count(*) FILTER (WHERE p.skill_id IS NOT NULL AND c.skill_id IS NOT NULL AND (
               {" OR ".join(f"c.{f} IS DISTINCT FROM p.{f}" for f in TRACKED_FIELDS)})) AS changed_skills
      FROM (SELECT * FROM snapshots WHERE scrape_run_id = 7) c
      FULL JOIN (SELECT * FROM snapshots WHERE scrape_run_id = 6) p ON c.skill_id = p.skill_id""",
    "platform_totals": _TOTALS,
    "top_share": _TOP_SHARE,
    "run_totals": _RUN_TOTALS,
    "run_percentiles": f"""
      SELECT scrape_run_id, strftime(d.started_at, '%Y-%m-%d') AS run_date,
             count(*) AS skill_count, {_PERCENTILES}
      FROM snapshots JOIN done d USING (scrape_run_id) GROUP BY scrape_run_id, d.started_at""",
    "weekly_new": _WEEKS,
    "weekly_growth": _WEEKLY_GROWTH,
    "avg_wow": f"""
      SELECT round(avg(wow_pct) FILTER (WHERE NOT is_forecast), 1) AS avg_wow_pct
      FROM ({_WEEKLY_GROWTH})""",
    "growth_timeline": _GROWTH_TIMELINE,
    "download_wow": f"""
      SELECT l.total_downloads AS latest_downloads, r.total_downloads AS reference_downloads,
             round((l.total_downloads - r.total_downloads) / r.total_downloads * 100, 1)
               AS download_wow_pct
      FROM (SELECT *, row_number() OVER (ORDER BY scrape_run_id DESC) AS age
            FROM ({_RUN_TOTALS})) l
      JOIN (SELECT *, row_number() OVER (ORDER BY scrape_run_id DESC) AS age
            FROM ({_RUN_TOTALS})) r ON l.age = 1 AND r.age = 8""",
    "platform_velocity": _PLATFORM_VELOCITY,
    "avg_platform_velocity": _AVG_PLATFORM_VELOCITY,
    "cohort_quality": _COHORT_QUALITY,
    "cohort_percentiles": f"""
      SELECT CAST(date_trunc('month', created_at) AS TIMESTAMP) AS cohort_month,
             count(*) AS skill_count, {_RATE_PERCENTILES}, round(avg({_RATE}), 1) AS avg_dl_per_day,
             CASE WHEN SUM(stat_downloads) > 0
                  THEN round(SUM(stat_stars) / SUM(stat_downloads), 4) ELSE 0 END AS star_dl_ratio
      FROM cur WHERE created_at IS NOT NULL GROUP BY 1""",
    "median_rate_windows": f"""
      SELECT *, CASE WHEN median_rate_prior > 0 THEN
               round((median_rate - median_rate_prior) / median_rate_prior * 100, 1) END
               AS median_mom_pct
      FROM (
        SELECT round(median({_RATE}) FILTER (WHERE created_at >= {_NOW} - INTERVAL 30 DAY), 1)
                 AS median_rate,
               round(median({_RATE}) FILTER (WHERE created_at >= {_NOW} - INTERVAL 60 DAY
                 AND created_at < {_NOW} - INTERVAL 30 DAY), 1) AS median_rate_prior
        FROM cur
      )""",
    "velocity": f"""
      SELECT *, {_ACCEL} AS acceleration_pct, {_TREND} AS trend FROM ({_VELOCITY})""",
    "velocity_chart": _CHARTS,
    "fastest_growing": _FASTEST,
    "leaderboard_all_time": _ALL_TIME,
    "owner_leaderboard": _top(
        "*", f"({_OWNER_TOTALS})", "total_downloads DESC, owner_handle", 20
    ),
    "owner_spam": _SPAM,
    "owner_stats": _OWNER_STATS,
    "owners_by_downloads": _owners_by("total_downloads"),
    "owners_by_stars": _owners_by("total_stars"),
    "owners_by_count": _owners_by("skill_count"),
    "owner_portfolio": _PORTFOLIO,
    "owner_entities": _OWNER_ENTITIES,
    "owner_trajectory": _TRAJECTORY,
    "owner_count_mom": """
      SELECT n.scrape_run_id, n.owners AS total_owners, r.scrape_run_id AS reference_run_id,
             r.owners AS reference_owners,
             CASE WHEN r.owners > 0 THEN round((n.owners - r.owners) / r.owners * 100, 1) END
               AS owners_mom_pct
      FROM (SELECT scrape_run_id, any_value(started_at) AS started_at,
                   count(DISTINCT owner_handle) AS owners FROM cur GROUP BY 1) n
      LEFT JOIN (
        SELECT scrape_run_id, d.started_at, count(DISTINCT owner_handle) AS owners
        FROM snapshots JOIN done d USING (scrape_run_id) GROUP BY ALL
      ) r ON r.started_at <= n.started_at - INTERVAL 30 DAY
      ORDER BY r.scrape_run_id DESC LIMIT 1""",
    "detail_owners": _DETAIL_OWNERS,
    "entity_history": """
      SELECT skill_id, scrape_run_id, d.started_at AS run_date, stat_downloads AS downloads,
             stat_stars AS stars, stat_installs_all_time AS installs_all_time,
             stat_installs_current AS installs_current
      FROM snapshots JOIN done d USING (scrape_run_id)""",
    "version_releases": _RELEASES,
    "entity_detail": f"""
      SELECT {_LISTED}, summary, created_at, age AS days_old, stat_downloads, stat_stars,
             '' AS tags, CAST(NULL AS VARCHAR) AS badges, stat_installs_all_time AS stat_installs,
             stat_comments, version_number AS current_version,
             round(stat_downloads / age, 1) AS velocity, {_ACCEL} AS acceleration_pct
      FROM (SELECT *, CASE WHEN created_at IS NOT NULL THEN
                    CAST(greatest(date_sub('day', created_at, {_NOW}), 1) AS INTEGER) END AS age
            FROM cur WHERE slug IS NOT NULL)
      LEFT JOIN ({_VELOCITY}) USING (skill_id)""",
    "report_sections": " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS section, count(*) AS rows FROM ({sql})"
        + (" HAVING count(*) > 0" if optional else "")
        for i, (name, sql, optional) in enumerate(_REPORT, 1)
    ),
    "flatten_items": """
      SELECT scrape_run_id, skill_id, slug, display_name, summary, created_at, updated_at,
             CAST(NULL AS VARCHAR) AS badges,
             CASE WHEN summary IS NOT NULL THEN '{"segment":"' || summary || '"}' END AS tags,
             stat_downloads, stat_stars, stat_comments, stat_installs_all_time,
             stat_installs_current, stat_versions, owner_handle,
             owner_handle AS owner_handle_top, version_number, version_changelog
      FROM snapshots""",
    "dumped_items": """
      SELECT skill_id, display_name, epoch_ms(created_at) AS created_ms,
             stat_downloads + 0.75e0 AS downloads, stat_stars + 0.75e0 AS stars,
             owner_handle AS handle, version_number AS version, owner_handle
      FROM cur""",
    "key_violations": """
      SELECT CAST(1 AS INTEGER) AS scrape_run_id, skill_id, count(*) AS rows
      FROM snapshots GROUP BY skill_id HAVING count(*) > 1""",
    "ingest_run_log": _RUN_LOG,
    "change_feed": _CHANGE_FEED,
    "feed_changes_long": _FEED_LONG,
    "feed_counts": f"""
      SELECT scrape_run_id, previous_run_id, new_skills, removed_skills, changed_skills
      FROM ({_DIFF_ALL}) WHERE previous_run_id IS NOT NULL""",
    "ingest_run_totals": f"""
      SELECT scrape_run_id, total_skills, total_downloads, total_stars FROM ({_RUN_TOTALS})""",
    "ingest_snapshots": """
      SELECT scrape_run_id, skill_id, created_at, stat_downloads, owner_handle,
             '{"segment":"' || summary || '"}' AS tags
      FROM snapshots SEMI JOIN done USING (scrape_run_id)""",
    "published_pages": _PAGE_LISTS,
    "published_details": f"""
      SELECT slug, 'point' AS kind, d.started_at AS run_date, stat_downloads AS downloads,
             CAST(NULL AS VARCHAR) AS version
      FROM {_DETAILED} JOIN (SELECT skill_id, scrape_run_id, stat_downloads FROM snapshots)
        USING (skill_id) JOIN done d USING (scrape_run_id)
      UNION ALL
      SELECT slug, 'release', run_date, NULL, version_number
      FROM {_DETAILED} JOIN ({_RELEASES}) USING (skill_id)""",
    "detail_lookups": f"""
      SELECT DISTINCT k.slug, d.skill_id IS NOT NULL AS found, d.display_name, d.stat_downloads
      FROM (SELECT c_name AS slug FROM customer
            UNION SELECT lower(replace(c_name, '#', '-')) FROM customer) k
      LEFT JOIN (SELECT cur.* FROM cur JOIN {_DETAILED} USING (skill_id)) d ON d.slug = k.slug""",
    "published_owners": f"""
      SELECT owner_key, skill_count, run_date, downloads, stars
      FROM ({_DETAIL_OWNERS}) JOIN ({_PORTFOLIO}) USING (owner_handle)
      JOIN ({_TRAJECTORY}) USING (owner_handle)""",
    "published_index": f"""
      SELECT 'entities' AS kind, count(*) AS count, string_agg(slug, ',' ORDER BY slug) AS available
      FROM ({_DETAIL_KEYS})
      UNION ALL
      SELECT 'owners', count(*), string_agg(owner_key, ',' ORDER BY owner_key)
      FROM ({_DETAIL_OWNERS})""",
    "owner_document_entities": f"""
      SELECT e.*, owner_key FROM ({_OWNER_ENTITIES}) e JOIN ({_DETAIL_OWNERS}) USING (owner_handle)""",
}

_OVER_TABLES = {
    "owner_key": _HANDLES,
    "owner_key_collisions": f"""
      SELECT owner_key, owner_handle FROM ({_HANDLES})
      QUALIFY count(*) OVER (PARTITION BY owner_key) > 1""",
    "epoch_ms_to_ts": """
      SELECT o_orderkey, make_timestamp(
               epoch_us(o_orderdate) + CAST(o_orderkey * 250 AS BIGINT)) AS created_at
      FROM orders""",
}


def oracle_sql() -> dict[str, str]:
    over_history = {name: f"{_HISTORY}\n{sql}" for name, sql in _OVER_HISTORY.items()}
    return over_history | _OVER_TABLES
