"""Queries of the surface lane. Lines of documents stand in for source lines, with planted code among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwork.operators import surface as S
from groundwork.plans.registry import Registry
from groundwork.sources.files import table

lane = Registry()
QUERIES, ORACLE, query = lane.QUERIES, lane.ORACLE, lane.query
DOMAIN = "example.com"

# Each document is a file of its source; six lines of code are planted after its own lines.
PLANTED = (
    "@app.get('/v1/items/{i}')",
    "export async function POST(req) {{",
    "const a = process.env.API_KEY_{m}; x = os.getenv('HOME_{m}')",
    "owner = 0x{h}",
    "see https://api{m}.partner.org/x and cdn{m}.example.com now",
    'chainId: "0x{m}"',
)
FILE = "CASE doc_id % 4 WHEN 0 THEN 'src/f' || doc_id || '.py' WHEN 1 THEN 'web/app/api/u' || doc_id || '/route.ts' WHEN 2 THEN 'api/g' || doc_id || '/index.js' ELSE 'docs/n' || doc_id || '.md' END"


def _lines(spark, sf_dir, moved: bool = False):
    d = table(spark, sf_dir, "documents").withColumn("m", F.col("doc_id") % 50)
    m = F.col("m").cast("string")
    planted = [F.replace(F.replace(F.replace(F.replace(F.lit(p.replace("{{", "{")), F.lit("{i}"), F.col("doc_id").cast("string")), F.lit("{m}"), m), F.lit("{h}"), F.substring(F.sha2(m, 256), 1, 40)), F.lit("{d}"), F.lit("")) for p in PLANTED]
    file = F.expr(FILE.replace("||", "||"))
    if moved:
        d = d.where("doc_id % 13 <> 5")
        file = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("src/moved/f"), F.col("doc_id"), F.lit(".py"))).otherwise(file)
    lines = F.concat(F.split("text", "\n"), F.array(*planted))
    rows = d.select(F.col("source").alias("repo"), file.alias("file"), F.posexplode(lines).alias("n", "line"))
    return rows.select("repo", "file", (F.col("n") + 1).alias("line_no"), "line")


def _lines_sql(name: str, moved: bool = False) -> str:
    cells = []
    for p in PLANTED:
        e = "'" + p.replace("{{", "{").replace("'", "''") + "'"
        for a, b in (("{i}", "doc_id::VARCHAR"), ("{m}", "(doc_id % 50)::VARCHAR"), ("{h}", "substr(sha256((doc_id % 50)::VARCHAR), 1, 40)")):
            e = f"replace({e}, '{a}', {b})"
        cells.append(e)
    file = f"CASE WHEN doc_id % 8 = 0 THEN 'src/moved/f' || doc_id || '.py' ELSE {FILE} END" if moved else FILE
    where = "WHERE doc_id % 13 <> 5" if moved else ""
    return f"{name} AS (SELECT repo, file, unnest(l) AS line, unnest(range(1, len(l) + 1))::INT AS line_no FROM (SELECT source AS repo, {file} AS file, list_concat(string_split(text, chr(10)), [{', '.join(cells)}]) AS l FROM documents {where}))"


def _routes_sql(src: str) -> str:
    return rf"""SELECT repo, 'api_route' AS type, upper(regexp_extract(t, '@[\w.]+\.(\w+)\(', 1)) AS subtype, regexp_extract(t, '\(\s*[''"]([^''"]+)', 1) AS value, file, line_no FROM (SELECT repo, file, line_no, unnest(regexp_extract_all(line, '(?i)@[\w.]+\.(?:get|post|put|delete|patch|options|head)\(\s*[''"][^''"]+[''"]')) AS t FROM {src} WHERE ends_with(file, '.py'))
UNION ALL SELECT repo, 'api_route', regexp_extract(t, '\b(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\b', 1), '/' || regexp_extract(file, '^.*?app/(api/.*)/[^/]*$', 1), file, line_no FROM (SELECT repo, file, line_no, unnest(regexp_extract_all(line, 'export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\b|export\s+const\s+(?:GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\s*=')) AS t FROM {src} WHERE contains(file, 'app/api/') AND regexp_matches(file, '/route\.[^/]*$') AND regexp_matches(file, '\.(ts|tsx|js|jsx)$'))
UNION ALL SELECT DISTINCT repo, 'api_route', 'ANY', '/' || regexp_replace(regexp_replace(file, '\.(ts|tsx|js|jsx)$', ''), '/index$', ''), file, 1 FROM {src} WHERE NOT contains(file, 'app/api/') AND regexp_matches(file, '(^|/)api/') AND regexp_matches(file, '\.(ts|tsx|js|jsx)$')"""


def _env_sql(src: str) -> str:
    each = ", ".join("regexp_extract_all(line, '" + p.replace("'", "''") + "', 1)" for p in S.ENV)
    return rf"SELECT repo, 'env_var', '', unnest(flatten([{each}])), file, line_no FROM {src} WHERE regexp_matches(file, '\.(ts|tsx|js|jsx|mjs|cjs|py)$')"


def _address_sql(src: str) -> str:
    return rf"SELECT repo, 'address', '', unnest(regexp_extract_all(line, '\b0x[a-fA-F0-9]{{40}}\b')), file, line_no FROM {src}"


def _domain_sql(src: str) -> str:
    # RE2 has no look-behind: words of host characters are cut first, which begin where none goes before.
    return rf"""SELECT repo, 'domain', 'literal', lower(regexp_extract(w, '(?i)^([a-zA-Z0-9][a-zA-Z0-9.-]*example\.com)(?:$|[^a-zA-Z0-9_])', 1)) AS value, file, line_no FROM (SELECT repo, file, line_no, unnest(regexp_extract_all(line, '[\w.-]+')) AS w FROM {src}) WHERE regexp_matches(w, '(?i)^[a-zA-Z0-9][a-zA-Z0-9.-]*example\.com(?:$|[^a-zA-Z0-9_])')
UNION ALL SELECT * FROM (SELECT repo, 'domain', 'url_host', lower(unnest(regexp_extract_all(line, 'https?://([a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}})', 1))) AS value, file, line_no FROM {src}) WHERE NOT contains(value, 'example.com')"""


def _chain_sql(src: str) -> str:
    p = S.CHAIN_ID.replace("'", "''")
    return f"SELECT repo, 'chain_id', '', unnest(regexp_extract_all(line, '{p}', 1)), file, line_no FROM {src}"


def _scan_sql(src: str) -> str:
    return " UNION ALL ".join(f(src) for f in (_routes_sql, _env_sql, _address_sql, _domain_sql, _chain_sql))


COLUMNS = "(repo, type, subtype, value, file, line_no)"
SCAN = f"WITH {_lines_sql('lines')}, found{COLUMNS} AS ({_scan_sql('lines')})"


def _twin(part: str) -> str:
    return f"WITH {_lines_sql('lines')}, found{COLUMNS} AS ({part}) SELECT * FROM found"


@query("c1_source_lines", f"WITH {_lines_sql('lines')} SELECT repo, file, count(*) AS n, max(line_no) AS last FROM lines GROUP BY ALL")
def c1(spark, sf_dir):
    """Files and their line counts; reading real trees is `scan_tree`, tested on a temporary one."""
    return _lines(spark, sf_dir).groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"))


@query("c2_routes", _twin(_routes_sql("lines")))
def c2(spark, sf_dir):
    return S.extract_routes(_lines(spark, sf_dir))


@query("c3_env_vars", _twin(_env_sql("lines")))
def c3(spark, sf_dir):
    return S.extract_env_vars(_lines(spark, sf_dir))


@query("c4_addresses", _twin(_address_sql("lines")))
def c4(spark, sf_dir):
    return S.extract_addresses(_lines(spark, sf_dir))


@query("c5_domains", _twin(_domain_sql("lines")))
def c5(spark, sf_dir):
    return S.extract_domains(_lines(spark, sf_dir), DOMAIN)


@query("c6_chain_ids", _twin(_chain_sql("lines")))
def c6(spark, sf_dir):
    return S.extract_chain_ids(_lines(spark, sf_dir))


@query("c6_scan_surface", SCAN + " SELECT * FROM found")
def c6_scan(spark, sf_dir):
    return S.scan_surface(_lines(spark, sf_dir), DOMAIN)


PLACES = "SELECT repo, type, subtype, value, file, count(*) AS n, min(line_no) AS first_line FROM {} GROUP BY ALL"


@query("c7_finding_places", SCAN + f" {PLACES.format('found')}")
def c7_places(spark, sf_dir):
    return S.finding_places(S.scan_surface(_lines(spark, sf_dir), DOMAIN))


@query("c7_group_findings", SCAN + f" SELECT repo, type, subtype, value, sum(n)::BIGINT AS places, count(*) AS n_files, min(file) AS first_file, string_agg(file || ':' || first_line, ',' ORDER BY file) AS files FROM ({PLACES.format('found')}) GROUP BY ALL")
def c7(spark, sf_dir):
    return S.group_findings(S.finding_places(S.scan_surface(_lines(spark, sf_dir), DOMAIN)))


GROUPED = "SELECT repo, type, subtype, value, list(DISTINCT file) AS fl FROM {} GROUP BY ALL"
DIFF = f"""{SCAN}, {_lines_sql('lines2', True)}, found2{COLUMNS} AS ({_scan_sql('lines2')}), a AS ({GROUPED.format('found')}), b AS ({GROUPED.format('found2')}),
diff AS (SELECT b.repo, b.type, b.subtype, b.value, 'added' AS change FROM b ANTI JOIN a USING (repo, type, subtype, value) UNION ALL SELECT a.repo, a.type, a.subtype, a.value, 'removed' FROM a ANTI JOIN b USING (repo, type, subtype, value)
 UNION ALL SELECT a.repo, a.type, a.subtype, a.value, 'moved' FROM a JOIN b USING (repo, type, subtype, value) WHERE a.type = 'api_route' AND NOT list_has_any(a.fl, b.fl))"""


def _diff(spark, sf_dir):
    return S.diff_surface(*[S.scan_surface(_lines(spark, sf_dir, moved), DOMAIN) for moved in (False, True)])


@query("c8_diff_surface", DIFF + " SELECT * FROM diff")
def c8(spark, sf_dir):
    return _diff(spark, sf_dir)


PRINTS = DIFF + """, dig AS (SELECT DISTINCT repo, sha256(change || '|' || type || '|' || subtype || '|' || value) AS h FROM diff), low AS (SELECT repo, h[1:6] AS p, sha256(string_agg(h, chr(10) ORDER BY h)) AS t FROM dig GROUP BY ALL),
mid AS (SELECT repo, p[1:3] AS q, sha256(string_agg(t, chr(10) ORDER BY p)) AS t FROM low GROUP BY ALL), prints AS (SELECT repo, sha256(string_agg(t, chr(10) ORDER BY q)) AS fingerprint FROM mid GROUP BY repo)"""


@query("c9_fingerprint_surface", PRINTS + " SELECT * FROM prints")
def c9(spark, sf_dir):
    return S.fingerprint_surface(_diff(spark, sf_dir))


@query("c10_surface_status", """WITH p AS (SELECT user_id AS repo, CASE WHEN max(event_id) % 5 = 0 THEN NULL ELSE arg_max(event_type, event_id) END AS fingerprint, max(ts) AS seen_at FROM events GROUP BY 1),
s AS (SELECT user_id AS repo, arg_min(event_type, event_id) AS old, min(ts) AS since FROM events WHERE user_id % 3 <> 0 GROUP BY 1), j AS (SELECT p.*, old, since, CASE WHEN p.repo % 11 = 0 THEN 'accepted' WHEN fingerprint IS NULL THEN 'silent' WHEN fingerprint = old THEN 'suppressed' ELSE 'reported' END AS status FROM p LEFT JOIN s USING (repo))
SELECT repo, status, CASE WHEN status IN ('suppressed', 'reported') THEN fingerprint END AS fingerprint, CASE WHEN status IN ('suppressed', 'reported') THEN coalesce(since, seen_at) END AS first_seen, CASE WHEN status IN ('suppressed', 'reported') THEN seen_at END AS last_seen FROM j""")
def c10(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("repo", F.col("user_id"))
    last = F.when(F.max("event_id") % 5 != 0, F.max_by("event_type", "event_id"))
    prints = e.groupBy("repo").agg(last.alias("fingerprint"), F.max("ts").alias("seen_at"))
    state = e.where("repo % 3 <> 0").groupBy("repo").agg(F.min_by("event_type", "event_id").alias("fingerprint"), F.min("ts").alias("first_seen"))
    return S.surface_status(prints, state, e.where("repo % 11 = 0"))


@query("c11_surface_counts", SCAN + " SELECT type, count(*) AS n FROM found GROUP BY type")
def c11(spark, sf_dir):
    return S.surface_counts(S.scan_surface(_lines(spark, sf_dir), DOMAIN))


@query("c12_redact", r"SELECT doc_id, replace(regexp_replace(text || ' https://u:p' || doc_id || '@host.example.com/x token-abc', '(https?://)[^/@\s]+@', '\1***@', 'g'), 'token-abc', '***') AS text FROM documents")
def c12(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" https://u:p"), F.col("doc_id"), F.lit("@host.example.com/x token-abc")).alias("text"))
    return S.redact(d, ["text"], ["token-abc"])
