"""Surface inventory of a source tree, given as lines: (repo, file, line_no, line)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions import exprs as X

# Which files hold text, code and nothing of ours.
TEXT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".json", ".env", ".yaml", ".yml", ".md", ".txt", ".toml", ".cfg", ".ini")
CODE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py")
SKIP_DIRS = (".git", "node_modules", ".next", ".vercel", "dist", "build", "venv", ".venv", "__pycache__", ".turbo", "coverage", ".pytest_cache", "out", ".cache", ".DS_Store")
# How code declares routes, reads its environment, and names addresses, hosts and chains.
DECORATOR = r"(?i)@[\w.]+\.(get|post|put|delete|patch|options|head)\(\s*['\"]([^'\"]+)['\"]"
EXPORT = r"export\s+(?:async\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\b|export\s+const\s+(?:GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\s*="
ENV = (
    r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)",
    r"process\.env\[\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]\s*\]",
    r"import\.meta\.env\.([A-Za-z_][A-Za-z0-9_]*)",
    r"os\.environ\.get\(\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]",
    r"os\.environ\[\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]\s*\]",
    r"os\.getenv\(\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]",
)
ADDRESS = r"\b0x[a-fA-F0-9]{40}\b"
URL_HOST = r"https?://([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
CHAIN_ID = r"(?i)chain[_-]?id\s*[:=]\s*['\"]?(0x[0-9a-fA-F]+|\d+)['\"]?"

PLACE = ("repo", "file", "line_no")
IDENTITY = ("repo", "type", "subtype", "value")
FINDINGS = "array<struct<type:string,subtype:string,value:string>>"


def _ends(names: Sequence[str]):
    test = F.lit(False)
    for n in names:
        test = test | F.col("file").endswith(n)
    return test


def _entries(type_: str, subtype, values, where=None):
    """Findings of one line as an array; none where the file or line does not count."""
    own = F.transform(values, lambda v: F.struct(F.lit(type_).alias("type"), (subtype(v) if callable(subtype) else F.lit(subtype)).alias("subtype"), v.alias("value")))
    return own if where is None else F.when(where, own).otherwise(F.array().cast(FINDINGS))


def _exploded(lines: DataFrame, *entries) -> DataFrame:
    """All findings in one pass over the lines."""
    every = F.concat(*entries) if len(entries) > 1 else entries[0]
    # An inner explode would test the array for emptiness first, and so run all patterns twice.
    return lines.select(*PLACE, F.explode_outer(every).alias("e")).where("e is not null").select("repo", "e.type", "e.subtype", "e.value", "file", "line_no")


def _route_entries() -> list:
    tags = F.regexp_extract_all("line", F.lit(f"({DECORATOR})"), F.lit(1))
    route = lambda subtype, value: F.struct(F.lit("api_route").alias("type"), subtype.alias("subtype"), value.alias("value"))
    none = F.array().cast(FINDINGS)
    decorated = F.transform(tags, lambda t: route(F.upper(F.regexp_extract(t, DECORATOR, 1)), F.regexp_extract(t, DECORATOR, 2)))
    script = _ends((".ts", ".tsx", ".js", ".jsx"))
    in_app = F.col("file").contains("app/api/")
    folder = F.concat(F.lit("/"), F.regexp_extract("file", r"^.*?app/(api/.*)/[^/]*$", 1))
    name = F.element_at(F.split("file", "/"), -1)
    handlers = F.transform(F.regexp_extract_all("line", F.lit(f"({EXPORT})"), F.lit(1)), lambda t: route(F.regexp_extract(t, r"\b(GET|POST|PUT|DELETE|PATCH|OPTIONS|HEAD)\b", 1), folder))
    bare = F.regexp_replace(F.regexp_replace("file", r"\.(ts|tsx|js|jsx)$", ""), "/index$", "")
    function = F.array(route(F.lit("ANY"), F.concat(F.lit("/"), bare)))
    return [
        F.when(F.col("file").endswith(".py"), decorated).otherwise(none),
        F.when(script & in_app & name.startswith("route."), handlers).otherwise(none),
        F.when(script & ~in_app & F.col("file").rlike("(^|/)api/") & (F.col("line_no") == 1), function).otherwise(none),
    ]


def extract_routes(lines: DataFrame) -> DataFrame:
    """Decorator routes of Python files, exported handlers below app/api, and one route for each function file below api, at its first line."""
    return _exploded(lines, *_route_entries())


def _env_entries() -> list:
    names = F.flatten(F.array(*[F.regexp_extract_all("line", F.lit(p), F.lit(1)) for p in ENV]))
    return [_entries("env_var", "", names, _ends(CODE_EXTENSIONS))]


def extract_env_vars(lines: DataFrame) -> DataFrame:
    """Names of environment variables that code files read."""
    return _exploded(lines, *_env_entries())


def _address_entries() -> list:
    return [_entries("address", "", F.regexp_extract_all("line", F.lit(f"({ADDRESS})"), F.lit(1)))]


def extract_addresses(lines: DataFrame) -> DataFrame:
    return _exploded(lines, *_address_entries())


def _domain_entries(own_domain: str) -> list:
    own = own_domain.lower().replace(".", r"\.")
    literal = F.transform(F.regexp_extract_all("line", F.lit(rf"(?i)(?<![\w.-])([a-zA-Z0-9][a-zA-Z0-9.-]*{own})\b"), F.lit(1)), F.lower)
    hosts = F.filter(F.transform(F.regexp_extract_all("line", F.lit(URL_HOST), F.lit(1)), F.lower), lambda h: ~h.contains(own_domain.lower()))
    return [_entries("domain", "literal", literal), _entries("domain", "url_host", hosts)]


def extract_domains(lines: DataFrame, own_domain: str) -> DataFrame:
    """Names under the own domain (literal), and hosts of urls elsewhere (url_host), lower-case."""
    return _exploded(lines, *_domain_entries(own_domain))


def _chain_entries() -> list:
    return [_entries("chain_id", "", F.regexp_extract_all("line", F.lit(CHAIN_ID), F.lit(1)))]


def extract_chain_ids(lines: DataFrame) -> DataFrame:
    return _exploded(lines, *_chain_entries())


def scan_surface(lines: DataFrame, own_domain: str) -> DataFrame:
    """All findings, in one pass over the lines; order them where they are shown."""
    return _exploded(lines, *_route_entries(), *_env_entries(), *_address_entries(), *_domain_entries(own_domain), *_chain_entries())


def finding_places(findings: DataFrame) -> DataFrame:
    """One row for each identity and file: n lines, the first of them. Places stay rows here, however many files an identity has."""
    return findings.groupBy(*IDENTITY, "file").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


def group_findings(places: DataFrame) -> DataFrame:
    """One row for each identity of `finding_places`: lines, files, the first file, and all its files with their first lines, as `file:line` in the order of files.

    A finding of every line is one entry for a file, but a row lists all its files.
    """
    entry = F.struct("file", F.concat("file", F.lit(":"), F.col("first_line").cast("string")).alias("t"))
    return places.groupBy(*IDENTITY).agg(
        F.sum("n").alias("places"), F.count(F.lit(1)).alias("n_files"), F.min("file").alias("first_file"), F.array_join(F.sort_array(F.collect_list(entry))["t"], ",").alias("files"),
    )


def diff_surface(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(identity, change): added, removed, and moved for routes whose files are all different. Inputs have a row for each identity and file, as `finding_places` or findings have.

    Both are put side by side and summed by identity and file, then by identity, with partial sums before each
    shuffle: an identity that a third of all lines have is a few rows by then.
    """
    key = list(IDENTITY)
    side = lambda df, was, now: df.select(*key, "file", F.lit(was).alias("was"), F.lit(now).alias("now"))
    files = side(baseline, True, False).union(side(current, False, True)).groupBy(*key, "file").agg(F.max("was").alias("was"), F.max("now").alias("now"))
    one = files.groupBy(*key).agg(F.max("was").alias("was"), F.max("now").alias("now"), F.max(F.col("was") & F.col("now")).alias("stayed"))
    change = F.when(~F.col("was"), "added").when(~F.col("now"), "removed").when((F.col("type") == "api_route") & ~F.col("stayed"), "moved")
    return one.select(*key, change.alias("change")).where("change is not null")


def digest_tree(digests: DataFrame, key: str, digest: str = "h", levels: Sequence[int] = (6, 3)) -> DataFrame:
    """(key, fingerprint) of each key's set of hex digests, whatever their order and however often each comes.

    Digests with the same first `levels[0]` hex digits are sorted, joined and hashed, then the hashes of all
    with the same first `levels[1]` digits, and so on, at last those of the key. A row gathers 4,096 hashes at
    most above the lowest level and, by (6, 3), a 16-millionth of a key's digests on it.
    """
    level = digests.select(key, F.col(digest).alias("p"), F.col(digest).alias("h")).distinct()
    for n in (*levels, 0):
        level = level.groupBy(key, F.substring("p", 1, n).alias("p")).agg(F.array_sort(F.collect_list(F.struct("p", "h"))).alias("c"))
        level = level.select(key, "p", X.sha256_hex(F.array_join(F.col("c.h"), "\n")).alias("h"))
    return level.select(key, F.col("h").alias("fingerprint"))


def fingerprint_surface(diff: DataFrame) -> DataFrame:
    """(repo, fingerprint) of a diff's changes, as a tree of their digests; a repo without changes has no row."""
    return digest_tree(diff.select("repo", X.sha256_hex(F.concat_ws("|", "change", "type", "subtype", "value")).alias("h")), "repo")


def surface_status(prints: DataFrame, state: DataFrame, accepts: DataFrame) -> DataFrame:
    """(repo, status, fingerprint, first_seen, last_seen) of prints (repo, fingerprint or null, seen_at) against the state.

    accepted: the diff becomes the new baseline; silent: nothing differs; suppressed: seen before; else
    reported, since the time at which this repo's open diff was first seen.
    """
    prior = state.select("repo", F.col("fingerprint").alias("old"), F.col("first_seen").alias("since"))
    ok = accepts.select("repo").distinct().withColumn("ok", F.lit(True))
    j = prints.join(prior, "repo", "left").join(ok, "repo", "left")
    status = F.when(F.col("ok"), "accepted").when(F.col("fingerprint").isNull(), "silent").when(F.col("fingerprint") == F.col("old"), "suppressed").otherwise("reported")
    open_ = F.col("status").isin("suppressed", "reported")
    rows = j.withColumn("status", status)
    return rows.select("repo", "status", F.when(open_, F.col("fingerprint")).alias("fingerprint"), F.when(open_, F.coalesce("since", "seen_at")).alias("first_seen"), F.when(open_, F.col("seen_at")).alias("last_seen"))


def surface_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def redact(df: DataFrame, cols: Sequence[str], secrets: Sequence[str] = ()) -> DataFrame:
    """Credentials in urls and known secrets as ***."""
    out = {}
    for c in cols:
        v = F.regexp_replace(c, r"(https?://)[^/@\s]+@", "$1***@")
        for s in secrets:
            v = F.replace(v, F.lit(s), F.lit("***"))
        out[c] = v
    return df.withColumns(out)
