"""SQL for DuckDB that gives the same rows as each query."""

from __future__ import annotations

AS_OF = "TIMESTAMP '2001-12-31 00:00:00'"

# The ticket view: rows as in checks/ticket_views.py, then the cleaned and derived columns.
_VIEW = """
v AS (
  SELECT o_orderkey AS order_key, 'CS' || lpad(o_orderkey::VARCHAR, 12, '0') AS number,
         c_name AS site, n_name AS company,
         CASE o_orderpriority WHEN '1-URGENT' THEN '1 - Critical' WHEN '2-HIGH' THEN '2 - High'
              WHEN '3-MEDIUM' THEN '3 - Medium' WHEN '5-LOW' THEN '4 - Low'
              ELSE o_orderpriority END AS priority,
         o_orderdate + to_minutes(o_orderkey % 1440) AS created,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate
              + to_minutes(o_orderkey % 1440 + floor(o_totalprice)::BIGINT % 20160) END AS resolved,
         p_type AS category, p_brand AS subcategory,
         repeat(coalesce(p_name, '') || ' ', 1 + o_orderkey % 8) AS words
  FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey)
         ON l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = first_part
)"""


def _days(start: str, end: str) -> str:
    return f"floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0)::BIGINT"


def _r1(x: str) -> str:
    return f"round_even(({x}) * 10, 0) / 10"


def _pct(part: str, whole: str) -> str:
    return f"({part})::DOUBLE / nullif(({whole})::DOUBLE, 0) * 100"


def _t1(x: str) -> str:
    return f"printf('%.1f', {x})"


_DERIVED = f"""
       (epoch_us(resolved) - epoch_us(created)) // 1000000 AS secs,
       ((epoch_us(resolved) - epoch_us(created)) // 1000000)::DOUBLE / 3600 AS hours,
       coalesce(priority = '1 - Critical', FALSE) AS crit, resolved IS NOT NULL AS done,
       {_days('created', AS_OF)} AS age"""

_T = f"""WITH {_VIEW},
t AS (
  SELECT number, site, company, priority, created, resolved,
         coalesce(category, '') AS category, coalesce(subcategory, '') AS subcategory,
         trim(words) AS short_description, {_DERIVED}
  FROM v
)"""

_MTTR = "sum(secs)::DOUBLE / nullif(count(secs) * 3600.0, 0)"
_MTTR1 = f"coalesce({_r1(_MTTR)}, 0.0)"
_ROLL = """
s AS (
  SELECT site, company, count(*) AS n_rows, count(number) AS n, count_if(crit) AS k,
         count_if(done) AS done, sum(secs) AS secs, count(secs) AS measured,
         min(created) AS first_created, max(created) AS last_created,
         min(created) FILTER (NOT done) AS first_open
  FROM t GROUP BY site, company
)"""

_RAW = f"""WITH {_VIEW},
r AS (
  SELECT
    CASE order_key % 50 WHEN 0 THEN chr(9) || site || ' ' || chr(160) WHEN 1 THEN 'N/A' WHEN 2 THEN ' nan '
         ELSE site END AS "Site",
    CASE WHEN order_key % 40 = 0 OR week % 23 < 2 THEN 'NULL'
         WHEN order_key % 40 IN (1, 2)
         THEN 'CS' || lpad((order_key - order_key % 40)::VARCHAR, 12, '0')
         ELSE number END AS "Number",
    CASE order_key % 9 WHEN 0 THEN 'said "' || words || '", left'
         WHEN 1 THEN words || chr(10) || 'second line' ELSE words END AS "Short description",
    CASE order_key % 35 WHEN 0 THEN 'nan' WHEN 1 THEN ' N/A' ELSE coalesce(category, '') END
      AS "Category",
    coalesce(subcategory, '') AS "Subcategory",
    CASE order_key % 30 WHEN 0 THEN priority || ' ' WHEN 1 THEN 'P1' WHEN 2 THEN 'n/a'
         ELSE priority END AS "Priority",
    CASE order_key % 20 WHEN 0 THEN strftime(created, '%Y-%m-%d %H:%M:00')
         WHEN 1 THEN strftime(created, '%-m/%-d/%Y')
         WHEN 2 THEN strftime(created, '%Y-%-m-%-d')
         WHEN 3 THEN 'not a date' WHEN 4 THEN ''
         WHEN 5 THEN strftime(created, '%-d/%-m/%Y %-H:%M')
         WHEN 6 THEN '2/30/1999 8:00'
         WHEN 7 THEN strftime(created, ' %-m/%-d/%Y  %-H:%M') || chr(9)
         ELSE strftime(created, '%-m/%-d/%Y %-H:%M') END AS "Created",
    CASE WHEN resolved IS NULL OR week % 23 = 1 THEN '' WHEN order_key % 25 = 0 THEN 'pending'
         ELSE strftime(resolved, '%-m/%-d/%Y %-H:%M') END AS "Resolved",
    CASE WHEN order_key % 45 = 0 THEN 'NATION_0' ELSE company END AS "Company",
    order_key::VARCHAR AS "Row key",
    CASE WHEN order_key % 8 = 0 THEN strftime(created, '%Y-%m-%d') ELSE strftime(created, '%-m/%-d/%Y') END
      AS "created_date"
  FROM (SELECT *, floor(date_diff('day', DATE '1970-01-05', created::DATE) / 7)::BIGINT AS week FROM v)
),
b AS (
  SELECT CASE WHEN COLUMNS(*) NOT IN ('', 'N/A', 'NULL', 'nan', 'n/a') THEN COLUMNS(*) END FROM r
)"""


def _parsed(column: str, *formats: str) -> str:
    text = f"regexp_replace(trim({column}, ' ' || chr(9)), '\\s+', ' ', 'g')"
    return "coalesce(" + ", ".join(f"try_strptime({text}, '{f}')" for f in formats) + ")"


_FORMATS = ("%m/%d/%Y %H:%M", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y", "%Y-%m-%d")
_MORE_FORMATS = _FORMATS + (
    "%d/%m/%Y %H:%M", "%d/%m/%Y", "%Y-%m-%d %H:%M", "%m-%d-%Y %H:%M", "%m-%d-%Y",
)
_SPARK_FORMATS = (
    "M/d/yyyy H:m", "yyyy-M-d H:m:s", "M/d/yyyy", "yyyy-M-d",
    "d/M/yyyy H:m", "d/M/yyyy", "yyyy-M-d H:m", "M-d-yyyy H:m", "M-d-yyyy",
)
_WS = "' ' || chr(9) || chr(10) || chr(160)"


def _clean(column: str) -> str:
    return f"coalesce(CASE WHEN trim({column}, {_WS}) <> 'nan' THEN trim({column}, {_WS}) END, '')"


_DAY = "strftime({}, '%Y-%m-%d')"
_MINUTE = "strftime({}, '%Y-%m-%d %H:%M')"


def _or_na(text: str) -> str:
    return f"coalesce({text}, 'N/A')"


def _hours_or_days(hours: str) -> str:
    return (f"CASE WHEN {hours} < 24 THEN {_t1(hours)} || 'h' "
            f"ELSE {_t1(f'{hours} / 24')} || 'd' END")


def _mttr_text(hours: str) -> str:
    return f"CASE WHEN {hours} > 0 THEN {_t1(hours)} || 'h' ELSE 'N/A' END"


def _pct_text(x: str) -> str:
    return _or_na(f"{_t1(x)} || '%'")


_HOTSPOTS = f"""{_T},
c AS (SELECT * FROM t WHERE priority = '1 - Critical'),
h AS (SELECT site, company, count(created) AS critical_count, max(created) AS latest_incident
      FROM c GROUP BY site, company HAVING count(created) >= 2),
l AS (SELECT site, company, created, number FROM c WHERE site IN (SELECT site FROM h)),
q AS (SELECT h.site, company, critical_count, latest_incident,
             {_days('latest_incident', AS_OF)} AS days_since_last FROM h)
"""

_SCORECARD = f"""{_T}, {_ROLL},
m AS (SELECT *, coalesce({_r1("secs::DOUBLE / nullif(measured * 3600.0, 0)")}, 0.0) AS mttr FROM s),
q AS (SELECT site, company, n AS total_tickets, k::BIGINT AS critical_count,
             {_r1(_pct('k', 'n'))} AS critical_pct, mttr AS avg_mttr_hours,
             measured AS resolved_count, done::BIGINT AS total_resolved,
             coalesce({_days('first_created', AS_OF)}, 0) AS longest_open_days,
             {_days('first_open', AS_OF)} AS longest_truly_open_days,
             CASE WHEN mttr > 48 THEN 'High Risk' WHEN mttr > 24 THEN 'Medium Risk'
                  ELSE 'Good' END AS status
      FROM m)
"""

_GREEN = f"""{_T}, {_ROLL},
q AS (SELECT site, company, n AS total_non_critical, last_created AS last_issue,
             {_days('last_created', AS_OF)} AS uptime_days FROM s WHERE k = 0)
"""

_FRANCHISE = f"""{_T},
p AS (SELECT company, site, count_if(crit) AS k FROM t GROUP BY company, site),
bw AS (SELECT company, arg_min(site, (k, site)) AS best_site,
              arg_min(site, (-k, site)) AS worst_site FROM p GROUP BY company),
c AS (SELECT company, count(DISTINCT site) AS sites, count(number) AS total_tickets,
             count_if(crit)::BIGINT AS critical_count, {_MTTR1} AS avg_mttr_hours,
             count_if(done)::BIGINT AS resolved_count FROM t GROUP BY company),
q AS (SELECT c.company, sites, total_tickets, critical_count,
             {_r1(_pct('critical_count', 'total_tickets'))} AS critical_pct, avg_mttr_hours,
             resolved_count, {_r1('total_tickets::DOUBLE / sites')} AS tickets_per_site,
             best_site, worst_site,
             {_r1(_pct('critical_count', 'total_tickets'))} + avg_mttr_hours / 10
               AS performance_score
      FROM c JOIN bw ON c.company = bw.company)
"""

_EQUIPMENT = f"""{_T},
g AS (SELECT category, subcategory, count(number) AS total_count,
             count_if(crit)::BIGINT AS critical_count, {_MTTR1} AS avg_mttr_hours
      FROM t GROUP BY category, subcategory),
p AS (SELECT category, subcategory, site, count(*) AS c FROM t GROUP BY ALL),
f AS (SELECT category, subcategory, arg_min(site, (-c, site)) AS most_affected_site
      FROM p GROUP BY category, subcategory),
q AS (SELECT g.category, g.subcategory, total_count,
             {_r1(_pct('total_count', '(SELECT count(*) FROM t)'))} AS pct_of_total, critical_count,
             {_r1(_pct('critical_count', 'total_count'))} AS critical_pct, avg_mttr_hours,
             most_affected_site
      FROM g JOIN f ON g.category = f.category AND g.subcategory = f.subcategory)
"""

_REPEAT = f"""{_T},
g AS (SELECT site, company, category, count(number) AS incident_count, min(created) AS a,
             max(created) AS z, count_if(crit)::BIGINT AS critical_count
      FROM t GROUP BY site, company, category HAVING count(number) >= 3),
q AS (SELECT site, company, category, incident_count,
             greatest(coalesce({_days('a', 'z')}, 0), 0) AS time_span_days, critical_count,
             incident_count * 10 + critical_count * 5 AS pattern_score FROM g)
"""

_RESOLUTION = f"""{_T},
g(priority, target_hours) AS (VALUES ('1 - Critical', 4.0::DOUBLE), ('2 - High', 24.0::DOUBLE),
                                     ('3 - Medium', 72.0::DOUBLE), ('4 - Low', 168.0::DOUBLE)),
q AS (SELECT site, number, t.priority, hours AS resolution_hours, target_hours,
             'Missed SLA' AS sla_status, (hours - target_hours) / 24 AS days_overdue
      FROM t JOIN g ON t.priority = g.priority WHERE done AND hours > target_hours)
"""

_TRENDS = f"""{_T},
d AS (SELECT date_trunc('week', created)::DATE AS week_start, isodow(created) AS dow, count(*) AS c,
             count(number) AS n, count_if(crit) AS k, count_if(done) AS done
      FROM t WHERE created IS NOT NULL GROUP BY ALL),
w AS (SELECT week_start, sum(n)::BIGINT AS new_tickets, sum(k)::BIGINT AS critical_count,
             sum(done)::BIGINT AS resolved_of_created, arg_min(dow, (-c, dow)) AS peak
      FROM d GROUP BY week_start),
q AS (SELECT week_start, new_tickets, critical_count,
             {_r1(_pct('critical_count', 'new_tickets'))} AS critical_pct, resolved_of_created,
             {_r1(_pct('resolved_of_created', 'new_tickets'))} AS resolution_pct,
             new_tickets - resolved_of_created AS backlog_change,
             ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][peak]
               AS peak_day FROM w)
"""

_INCIDENTS = f"""{_T},
q AS (SELECT site, number,
             CASE WHEN length(short_description) > 60 THEN substr(short_description, 1, 57) || '...'
                  WHEN short_description <> '' THEN short_description
                  ELSE 'No description' END AS description,
             CASE WHEN category <> '' THEN category ELSE 'Other' END
               || CASE WHEN subcategory <> '' THEN ' - ' || subcategory ELSE '' END
               AS category_label,
             priority, created, resolved, hours AS resolution_hours,
             CASE WHEN NOT done THEN age END AS days_open,
             CASE WHEN done THEN 'Resolved' ELSE 'Open' END AS status, company FROM t)
"""

_REPORTS = {
    "critical_hotspots": (_HOTSPOTS, f"""
      site AS "Site", company AS "Company", critical_count AS "Critical Count",
      {_or_na(_MINUTE.format('latest_incident'))} AS "Latest Incident",
      {_or_na('days_since_last::VARCHAR')} AS "Days Since Last" """),
    "site_scorecard": (_SCORECARD, f"""
      site AS "Site", company AS "Company", total_tickets AS "Total Tickets",
      critical_count AS "Critical Count", {_pct_text('critical_pct')} AS "Critical %",
      {_mttr_text('avg_mttr_hours')} AS "Avg MTTR",
      CASE WHEN longest_open_days > 0 THEN longest_open_days::VARCHAR ELSE 'N/A' END
        AS "Longest Open (days)",
      CASE status WHEN 'High Risk' THEN '🔴 High Risk' WHEN 'Medium Risk' THEN '🟡 Medium Risk'
                  ELSE '🟢 Good' END AS "Status" """),
    "green_list": (_GREEN, f"""
      site AS "Site", company AS "Company", total_non_critical AS "Total Non-Critical",
      {_or_na(_DAY.format('last_issue'))} AS "Last Issue",
      {_or_na('uptime_days::VARCHAR')} AS "Uptime Days" """),
    "franchise_overview": (_FRANCHISE, f"""
      company AS "Company", sites AS "Sites", total_tickets AS "Total Tickets",
      {_pct_text('critical_pct')} AS "Critical %", {_mttr_text('avg_mttr_hours')} AS "Avg MTTR",
      {_t1('tickets_per_site')} AS "Tickets/Site", best_site AS "Best Site",
      worst_site AS "Worst Site" """),
    "equipment_analysis": (_EQUIPMENT, f"""
      category AS "Category", subcategory AS "Subcategory", total_count AS "Count",
      {_pct_text('pct_of_total')} AS "% of Total", critical_count AS "Critical",
      {_pct_text('critical_pct')} AS "Critical %", {_mttr_text('avg_mttr_hours')} AS "Avg MTTR",
      most_affected_site AS "Most Affected Site" """),
    "repeat_offenders": (_REPEAT, """
      site AS "Site", company AS "Company", category AS "Category",
      incident_count AS "Incident Count", time_span_days AS "Time Span (days)",
      critical_count AS "Critical Count", pattern_score AS "Pattern Score" """),
    "resolution_tracking": (_RESOLUTION, f"""
      site AS "Site", {_or_na('number')} AS "Ticket #", priority AS "Priority",
      {_hours_or_days('resolution_hours')} AS "Resolution Time",
      CASE priority WHEN '1 - Critical' THEN '4h' WHEN '2 - High' THEN '1.0d'
                    WHEN '3 - Medium' THEN '3.0d' ELSE '7.0d' END AS "Target",
      '🔴 Missed SLA' AS "SLA Status", {_t1('days_overdue')} || 'd' AS "Days Overdue" """),
    "workload_trends": (_TRENDS, f"""
      strftime(week_start, '%m/%d') || ' - ' || strftime(week_start + 6, '%m/%d') AS "Week",
      new_tickets AS "New Tickets", critical_count AS "Critical",
      {_pct_text('critical_pct')} AS "Critical %", resolved_of_created AS "Resolved",
      {_pct_text('resolution_pct')} AS "Resolution %",
      CASE WHEN backlog_change > 0 THEN '📈 ' WHEN backlog_change < 0 THEN '📉 ' ELSE '➡️ ' END
        || abs(backlog_change)::VARCHAR AS "Backlog Change",
      peak_day AS "Peak Day" """),
    "incident_details": (_INCIDENTS, f"""
      site AS "Site", {_or_na('number')} AS "Ticket #", description AS "Description",
      category_label AS "Category", priority AS "Priority",
      {_or_na(_MINUTE.format('created'))} AS "Created",
      CASE WHEN status = 'Open' THEN 'Open' ELSE {_MINUTE.format('resolved')} END AS "Resolved",
      CASE WHEN status = 'Open' THEN {_or_na("days_open::VARCHAR || 'd open'")}
           WHEN resolution_hours > 0 THEN {_hours_or_days('resolution_hours')}
           ELSE 'N/A' END AS "Resolution Time",
      status AS "Status", company AS "Company" """),
}

_FILTER_COLUMNS = "number, site, company, priority, created, done AS is_resolved"
_ALL_PRIORITIES = "('1 - Critical', '2 - High', '3 - Medium', '4 - Low')"
_FILTERS = {
    "filter_date_range":
        "created >= TIMESTAMP '1997-03-01' AND created <= TIMESTAMP '1998-06-30'",
    "filter_inclusive_end":
        "created >= TIMESTAMP '1997-03-01' AND created < TIMESTAMP '1998-07-01'",
    "filter_priority": "priority IN ('1 - Critical', '2 - High')",
    "filter_company": "company = 'NATION_7'",
    "filter_site": "site = 'Customer#000000017'",
    "filter_category": "category = 'ECONOMY' AND subcategory = 'Brand#2'",
    "filter_status": f"NOT done AND priority IN {_ALL_PRIORITIES}",
    "filter_preset":
        "created >= TIMESTAMP '1999-04-16' AND created <= TIMESTAMP '1999-07-15'",
    "filter_year_to_date":
        "created >= TIMESTAMP '1999-01-01' AND created <= TIMESTAMP '1999-07-15'",
}

_CUT_DAYS = "created >= TIMESTAMP '1997-03-01 06:30:00' AND created <= TIMESTAMP '1998-06-30 18:15:00'"

_TOTALS = f"""{_T},
a AS (SELECT count(*) AS n, count_if(crit)::BIGINT AS k, count_if(done)::BIGINT AS done,
             count(DISTINCT site) AS sites, count(DISTINCT company) AS companies,
             min(created) AS first_created, max(created) AS last_created,
             count(created) AS created_count, min(resolved) AS first_resolved,
             max(resolved) AS last_resolved, {_MTTR} AS hours FROM t)
"""


_SHEET = _TOTALS + " UNION ALL ".join(
    f"SELECT {i} AS position, '{metric}' AS metric, {value} AS value FROM a"
    for i, (metric, value) in enumerate([
        ("Report Generated", "'2001-12-31 00:00:00'"),
        ("Total Records", "n::VARCHAR"),
        ("Critical Incidents", "k::VARCHAR"),
        ("Critical Percentage", f"{_t1(_r1(_pct('k', 'n')))} || '%'"),
        ("Resolved Tickets", "done::VARCHAR"),
        ("Resolution Rate", f"{_t1(_r1(_pct('done', 'n')))} || '%'"),
        ("Open Tickets", "(n - done)::VARCHAR"),
        ("Unique Sites", "sites::VARCHAR"),
        ("Unique Companies", "companies::VARCHAR"),
        ("Average Resolution Time (hours)", _t1(_r1("hours"))),
        ("Date Range Start", _DAY.format("first_created")),
        ("Date Range End", _DAY.format("last_created")),
    ], start=1)
)

_SUMMARY_LINES = _TOTALS + " UNION ALL ".join(
    f"SELECT {i} AS position, {line} AS line FROM a"
    for i, line in enumerate([
        "'Total Tickets: ' || format('{:,}', n)",
        f"'Critical Tickets: ' || format('{{:,}}', k) || ' (' || {_t1(_pct('k', 'n'))} || '%)'",
        f"'Resolved Tickets: ' || format('{{:,}}', done) || ' (' || {_t1(_pct('done', 'n'))} || '%)'",
        "'Open Tickets: ' || format('{:,}', n - done)",
        "'Unique Sites: ' || format('{:,}', sites)",
        "'Unique Companies: ' || format('{:,}', companies)",
        f"'Average Resolution Time: ' || {_t1('hours')} || ' hours'",
        f"'Date Range: ' || {_DAY.format('first_created')} || ' to ' || {_DAY.format('last_created')}",
        f"'Time Span: ' || {_days('first_created', 'last_created')} || ' days'",
    ], start=1)
)

_PAIRS = _T + ", p AS (SELECT DISTINCT category, subcategory FROM t WHERE category <> '')"
_OPTIONS = _T + """, o AS (
  SELECT 'priority' AS field, priority AS value FROM t UNION SELECT 'company', company FROM t
  UNION SELECT 'site', site FROM t UNION SELECT 'category', category FROM t WHERE category <> '')
"""

_BAD_CREATED = f"count_if({_parsed('\"Created\"', *_FORMATS)} IS NULL)"
_BAD_RESOLVED = f"""count_if("Resolved" IS NOT NULL AND {_parsed('"Resolved"', *_FORMATS)} IS NULL)"""
_REQUIRED = ("Site", "Priority", "Created", "Company")
_COMPLETENESS = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count_if("{c}" IS NULL)::BIGINT AS null_count,
        {_r1(_pct(f'count_if("{c}" IS NULL)', 'count(*)'))} AS null_pct,
        {_r1("100 - " + _pct(f'count_if("{c}" IS NULL)', 'count(*)'))} AS completeness_pct,
        {_pct(f'count_if("{c}" IS NULL)', 'count(*)')} > 10 AS warns FROM b"""
    for c in _REQUIRED
)
_DUPLICATES = """(SELECT count(*) FROM (SELECT "Number" FROM b WHERE "Number" IS NOT NULL
                  GROUP BY "Number" HAVING count(*) > 1))"""


def _dq_report(missing: str = "") -> str:
    def row(check: str, column: str, severity: str, count: str, message: str, when: str) -> str:
        return (f"SELECT '{check}' AS check_name, '{column}' AS column_name, "
                f"'{severity}' AS severity, {count}::BIGINT AS finding_count, "
                f"{message} AS message FROM b HAVING {when}")

    rows = [row("record_count", "", "info", "count(*)", "count(*)::VARCHAR || ' records'", "TRUE")]
    if missing:
        rows.append(f"SELECT 'required_columns', '{missing}', 'error', 1, "
                    f"'Missing required columns: {missing}'")
    for c in (c for c in _REQUIRED if c != missing):
        share = _pct(f'count_if("{c}" IS NULL)', "count(*)")
        rows.append(row("completeness", c, "warning", f'count_if("{c}" IS NULL)',
                        f"'Column ''{c}'' has ' || {_t1(share)} || '% missing values'",
                        f"{share} > 10"))
    unexpected = (f'count(DISTINCT "Priority") FILTER ("Priority" NOT IN {_ALL_PRIORITIES})')
    rows.append(row("priority_values", "Priority", "warning", unexpected,
                    f"{unexpected}::VARCHAR || ' unexpected priority values found'",
                    f"{unexpected} > 0"))
    rows.append(row("bad_dates", "Created", "warning", _BAD_CREATED,
                    f"'Column ''Created'' has ' || {_BAD_CREATED}::VARCHAR || "
                    "' invalid date formats'", f"{_BAD_CREATED} > 0"))
    rows.append(row("bad_dates", "Resolved", "warning", _BAD_RESOLVED,
                    f"'Column ''Resolved'' has ' || {_BAD_RESOLVED}::VARCHAR || "
                    "' invalid date formats (excluding legitimately empty values)'",
                    f"{_BAD_RESOLVED} > 0"))
    rows.append(f"SELECT 'duplicates', 'Number', 'warning', {_DUPLICATES}::BIGINT, "
                f"'Found ' || {_DUPLICATES}::VARCHAR || ' duplicate ticket numbers' "
                f"WHERE {_DUPLICATES} > 0")
    return _RAW + " UNION ALL ".join(rows)


def _detect(column: str) -> str:
    shares = ", ".join(
        f"count_if({_parsed(column, f)} IS NOT NULL)::DOUBLE / count(*) AS s{i}"
        for i, f in enumerate(_MORE_FORMATS, start=1)
    )
    long = " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS date_format, s{i} AS match_share FROM a"
        for i, name in enumerate(_SPARK_FORMATS, start=1)
    )
    return f"""{_RAW}, a AS (SELECT {shares} FROM b), l AS ({long})
      SELECT *, match_share > 0.8 AND position = (SELECT arg_min(position, (-match_share, position))
             FROM l) AS detected FROM l"""


_CLEANED = f"""{_RAW},
n AS (
  SELECT {_clean('"Site"')} AS site, "Number" AS number,
         {_clean('"Short description"')} AS short_description,
         {_clean('"Category"')} AS category, {_clean('"Subcategory"')} AS subcategory,
         trim("Priority", {_WS}) AS priority, {_parsed('"Created"', *_FORMATS)} AS created,
         {_parsed('"Resolved"', *_FORMATS)} AS resolved, {_clean('"Company"')} AS company, "Row key",
         "created_date"
  FROM b
)"""
_NORMALIZED = f"""{_CLEANED}
SELECT * EXCLUDE (secs, hours, crit, done, age), secs::DOUBLE AS resolution_seconds,
       hours AS resolution_hours, crit AS is_critical, done AS is_resolved, age AS days_since_created
FROM (SELECT *, {_DERIVED} FROM n)
"""
# The cleaned untidy tickets in the place of the tidy ones.
_UNTIDY = f"""{_CLEANED},
t AS (SELECT *, {_DERIVED} FROM n)"""


def _untidy(sql: str) -> str:
    return sql.replace(_T, _UNTIDY)


_SAMPLES = f"""{_GREEN},
k AS (SELECT site, number, row_number() OVER (PARTITION BY site ORDER BY number IS NULL,
             created NULLS LAST, number) AS i, count(*) OVER (PARTITION BY site) AS c FROM t),
x AS (SELECT site, string_agg(number, ', ' ORDER BY i) FILTER (i <= 3) AS shown, any_value(c) AS c,
             count(number) AS given FROM k GROUP BY site)
SELECT q.*, CASE WHEN shown IS NULL THEN 'No ticket #s' ELSE shown || CASE WHEN given >= 3 AND c > 3
       THEN ' (+' || (c - 3) || ' more)' ELSE '' END END AS sample_tickets
FROM q JOIN x ON q.site = x.site
"""


def _export_counts() -> str:
    counts = [f"SELECT 'raw_data' AS dataset, count(*) AS row_count FROM ({_T} SELECT * FROM t)",
              f"SELECT 'summary', count(*) FROM ({_SHEET})"]
    counts += [f"SELECT '{name}', count(*) FROM ({core} SELECT * FROM q)" for name, (core, _) in _REPORTS.items()]
    return " UNION ALL ".join(counts)


def oracle_sql() -> dict[str, str]:
    found = {
        "ticket_load": _RAW
        + """SELECT *, CASE WHEN "Row key"::BIGINT % 33 = 0 THEN TRUE END AS over_long FROM b""",
        "ticket_load_json": _RAW + "SELECT * FROM b",
        "ticket_load_table": _RAW + "SELECT * FROM r",
        "dq_malformed_rows": _RAW + """
            SELECT 'record_count' AS check_name, '' AS column_name, 'info' AS severity,
                   count(*) AS finding_count, count(*)::VARCHAR || ' records' AS message FROM b
            UNION ALL SELECT 'malformed_rows', '', 'warning', count(*),
                   count(*)::VARCHAR || ' rows have more cells than the header' FROM b
                   WHERE "Row key"::BIGINT % 33 = 0""",
        "null_tokens": _RAW + "SELECT * FROM b",
        "column_rename": _RAW
        + 'SELECT "Site", "Priority", "Created", "Company", "Category", "Number" FROM b',
        "load_metadata": _T + f"""SELECT 'loaded/orders.parquet' AS file_path,
            'orders.parquet' AS file_name, {AS_OF} AS load_timestamp,
            count(*) AS total_records,
            'site, number, short_description, category, subcategory, priority, created, resolved, '
            || 'company, resolution_seconds, resolution_hours, is_critical, is_resolved, '
            || 'days_since_created' AS columns FROM t""",
        "export_selected": _SCORECARD + """SELECT * FROM q WHERE (site, company) IN
            (SELECT (site, company) FROM t WHERE crit GROUP BY site, company
             HAVING count(created) >= 2)""",
        "filtered_raw": _T + """SELECT site AS "Site", number AS "Number",
            short_description AS "Short description", category AS "Category",
            subcategory AS "Subcategory", priority AS "Priority", created AS "Created",
            resolved AS "Resolved", company AS "Company" FROM t
            WHERE priority IN ('1 - Critical', '2 - High', '3 - Medium')""",
        "summary_sheet": _SHEET,
        "dq_required_columns": _dq_report(missing="Company"),
        "dq_report": _dq_report(),
        "dq_no_rows": _RAW + """SELECT 'record_count' AS check_name, '' AS column_name, 'info' AS severity,
                   count(*) AS finding_count, count(*)::VARCHAR || ' records' AS message
            FROM b WHERE "Site" = 'no such site'
            UNION ALL SELECT 'no_data', '', 'error', 0::BIGINT, 'No data found in file'""",
        "dq_completeness": _RAW + _COMPLETENESS,
        "dq_unexpected_priority": _RAW
        + f'SELECT DISTINCT "Priority" FROM b WHERE "Priority" NOT IN {_ALL_PRIORITIES}',
        "dq_duplicates": _RAW + f"SELECT {_DUPLICATES} AS duplicate_numbers",
        "dq_bad_dates": _RAW + f"""
            SELECT 'Created' AS column_name, {_BAD_CREATED}::BIGINT AS bad_dates FROM b
            UNION ALL SELECT 'Resolved', {_BAD_RESOLVED}::BIGINT FROM b""",
        "dataset_profile": _T + """SELECT count(*) AS processed_records, count(*) AS raw_records,
            'site, number, short_description, category, subcategory, priority, created, resolved, '
            || 'company, resolution_seconds, resolution_hours, is_critical, is_resolved, '
            || 'days_since_created' AS columns,
            count(DISTINCT site) AS sites, count(DISTINCT company) AS companies,
            count(DISTINCT category) FILTER (category <> '') AS categories FROM t""",
        "date_range": _T + """SELECT 'Created' AS date_column, min(created) AS min_date,
            max(created) AS max_date, count(created) AS date_count FROM t
            UNION ALL SELECT 'Resolved', min(resolved), max(resolved), count(resolved) FROM t""",
        "detect_date_format": _detect('"Resolved"'),
        "detect_date_format_found": _detect('"created_date"'),
        "parse_dates": _RAW + f"""SELECT "Row key" AS row_key, "Created" AS created_text,
            {_parsed('"Created"', *_MORE_FORMATS)} AS created_time,
            {_parsed('"Resolved"', *_MORE_FORMATS)} AS resolved_time FROM b""",
        "normalize": _NORMALIZED,
        "filter_options": _OPTIONS + "SELECT * FROM o",
        "option_search": _OPTIONS + "SELECT * FROM o WHERE contains(lower(value), 'nation_1')",
        "category_map": _PAIRS + "SELECT category, subcategory FROM p",
        "subcategories": _PAIRS + "SELECT subcategory FROM p WHERE category = 'ECONOMY'",
        "all_subcategories": _PAIRS + "SELECT DISTINCT subcategory FROM p",
        "sites_for_company": _T + "SELECT DISTINCT site FROM t WHERE company = 'NATION_7'",
        "report_summary": _TOTALS + f"""SELECT n AS total_tickets, k AS critical_tickets,
            {_r1(_pct('k', 'n'))} AS critical_pct, done AS resolved_tickets,
            {_r1(_pct('done', 'n'))} AS resolution_rate, sites AS unique_sites,
            companies AS unique_companies, first_created, last_created,
            {_r1('hours')} AS avg_mttr_hours FROM a""",
        "data_summary": _TOTALS + f"""SELECT n AS total_tickets, k AS critical_tickets,
            {_pct('k', 'n')} AS critical_pct, done AS resolved_tickets,
            {_pct('done', 'n')} AS resolved_pct, n - done AS open_tickets, sites AS unique_sites,
            companies AS unique_companies, first_created, last_created, created_count,
            first_resolved, last_resolved, done AS resolved_count, hours AS avg_resolution_hours,
            {_days('first_created', 'last_created')} AS time_span_days FROM a""",
        "data_summary_display": _SUMMARY_LINES,
        "filtered_count": _T + f"""SELECT count(*) AS total_tickets,
            count_if(crit)::BIGINT AS critical_tickets, 'Filtered: ' || count(*) || ' tickets' ||
            CASE WHEN count_if(crit) > 0 THEN ' (' || count_if(crit) || ' critical)' ELSE '' END
            AS status_text FROM t WHERE {_FILTERS['filter_year_to_date']}""",
        "hotspot_tickets": _HOTSPOTS + "SELECT * FROM l",
        "hotspot_tickets_display": _HOTSPOTS + f"""SELECT site AS "Site", company AS "Company",
            {_or_na(_MINUTE.format('created'))} AS "Created", coalesce(number, 'No ticket #') AS "Ticket #"
            FROM l""",
        "hotspot_tickets_untidy": _untidy(_HOTSPOTS) + "SELECT * FROM l",
        "filter_untidy": _UNTIDY + f"""SELECT "Row key", number, site, created, created_date FROM t
            WHERE {_FILTERS['filter_date_range']}""",
        "filter_cleared": _T + f"SELECT {_FILTER_COLUMNS} FROM t",
        "active_filters": _T + f"""SELECT 'Priorities: 1 - Critical, 2 - High' AS filter,
            count(*) AS total_tickets FROM t WHERE {_FILTERS['filter_priority']}""",
        "export_counts": _export_counts(),
        "sample_tickets_untidy": _untidy(_SAMPLES),
        "site_drill_down": _INCIDENTS + "SELECT * FROM q WHERE site = 'Customer#000000017'",
        "sample_tickets": _SAMPLES,
    }
    for name in ("report_summary", "data_summary", "filtered_count"):
        found[f"rollup_{name}"] = found[name]
    for name in ("site_scorecard", "green_list", "franchise_overview"):
        found[f"rollup_{name}"] = _REPORTS[name][0] + "SELECT * FROM q"
    found["rollup_cut_days"] = found["filtered_count"].replace(_FILTERS["filter_year_to_date"], _CUT_DAYS)
    found["approximate_counts"] = _T + """SELECT count(*) AS processed_records, count(DISTINCT site) AS sites,
        count(DISTINCT company) AS companies, count(DISTINCT category) FILTER (category <> '') AS categories,
        TRUE AS sites_within, TRUE AS companies_within, TRUE AS categories_within FROM t"""
    found["load_metadata_files"] = " UNION ALL ".join(
        f"""SELECT '{table}.parquet' AS file_name, {AS_OF} AS load_timestamp, 'o_orderkey, c_custkey' AS columns,
            count(*) AS total_records FROM {table}""" for table in ("orders", "customer"))
    found["column_rename_mixed"] = _RAW + """SELECT "Site", "Priority", "Created", "Company",
        CASE WHEN "Row key"::BIGINT % 2 = 0 THEN "Category" END AS "Category", "Number" FROM b"""
    found["dq_report_noted"] = found["dq_report"]
    for name, (core, shown) in _REPORTS.items():
        found[name] = core + "SELECT * FROM q"
        found[f"{name}_display"] = core + f"SELECT {shown} FROM q"
        found[f"{name}_untidy"] = _untidy(core) + "SELECT * FROM q"
        found[f"{name}_untidy_display"] = _untidy(core) + f"SELECT {shown} FROM q"
    for name in ("report_summary", "data_summary"):
        found[f"{name}_untidy"] = _untidy(found[name])
    for name, condition in _FILTERS.items():
        found[name] = _T + f"SELECT {_FILTER_COLUMNS} FROM t WHERE {condition}"
    return found
