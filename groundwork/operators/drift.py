"""Content drift: pages against an accepted baseline, hunks, the facts they touch, and findings."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions import exprs as X
from groundwork.functions.workers import ship
from groundwork.operators import alignment, markup

# What counts as page chrome.
CHROME_TAGS = ("script", "style", "nav", "header", "footer", "noscript", "svg")
CHROME_CLASSES = ("nav", "navbar", "footer", "site-footer", "site-header")
CHROME_ATTRIBUTES = ("data-nav",)
# What ends a line, and what counts as blank at a line's ends, in any script.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
OUTER_BLANKS = r"^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$"
# Token patterns, in the order in which spans are claimed.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
TOKENS = (
    ("address", r"0x[a-fA-F0-9]{40}"),
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    ("url", r"https?://[^\s)\"'<>]+"),
    ("date", rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b|\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b"),
    ("number", r"(?<![\w.])\d[\d,]*(?:\.\d+)?%?(?![\w])"),
)
# Letters, digits, blanks and word ends of every script count.
UNICODE = "(?U)"
# What every token of a category holds.
MARKS = {"address": "0x", "email": "@", "url": "://"}


def html_body_text(pages: DataFrame, html: str = "html", strip_tags: tuple[str, ...] = CHROME_TAGS, strip_classes: tuple[str, ...] = CHROME_CLASSES, strip_attributes: tuple[str, ...] = CHROME_ATTRIBUTES, out: str = "text") -> DataFrame:
    """Body text of a page, one run of text on each line, without comments and chrome.

    Elements of the tags, with one of the classes in their class list, or with one of the attributes go
    with all that they hold, however they nest. A page without a body counts whole. Entities are told
    by the full table. Only the html column goes to Python; a null page has a null text.
    """
    ship(pages.sparkSession)
    tags, classes, attributes = frozenset(strip_tags), frozenset(strip_classes), frozenset(strip_attributes)

    @F.arrow_udf("string")
    def text_of(html: pa.Array) -> pa.Array:
        return pa.array([None if x is None else markup.body_text(x, tags, classes, attributes) for x in html.to_pylist()], pa.string())

    return pages.withColumn(out, text_of(F.col(html)))


def normalize_lines(df: DataFrame, text: str = "text", out: str = "text") -> DataFrame:
    """Blanks folded, lines trimmed, empty lines dropped. Only the text column goes to Python, as expressions would go over each line several times."""
    ship(df.sparkSession)
    lines_of = F.arrow_udf(lambda text: pa.array([None if x is None else markup.collapsed(x) for x in text.to_pylist()], pa.string()), "string")
    return df.withColumn(out, lines_of(text))


def build_baseline(pages: DataFrame, seeded_from: str, text: str = "text") -> DataFrame:
    """(slug, text, sha256, seeded_from) of normalised pages."""
    return pages.select("slug", F.col(text).alias("text"), X.sha256_hex(text).alias("sha256"), F.lit(seeded_from).alias("seeded_from"))


def compare_baseline(base: DataFrame, current: DataFrame) -> DataFrame:
    """(slug, status, old_sha, new_sha): unchanged, changed, new or missing. A page whose text is null on a side is there, and changed."""
    a = base.select(F.col("slug").alias("old"), F.col("sha256").alias("old_sha"))
    b = current.select(F.col("slug").alias("new"), X.sha256_hex("text").alias("new_sha"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("changed")
    return a.join(b, F.col("old") == F.col("new"), "full").select(F.coalesce("old", "new").alias("slug"), status.alias("status"), "old_sha", "new_sha")


def changed_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(slug, old_text, new_text) where both are there and differ; texts are compared before any line is made.

    Spark judges the size of texts and leaves that it has not made by the files they come from, which may be far smaller, and
    would gather a whole side on the driver to broadcast it. Here and below such sides are merged.
    """
    both = old.select("slug", F.col("text").alias("old_text")).join(new.select("slug", F.col("text").alias("new_text")).hint("merge"), "slug")
    # Of a bare comparison Spark infers that no text is null, asks so before the join, and makes each text again for it.
    return both.where(F.when(F.col("old_text").isNotNull() & F.col("new_text").isNotNull(), F.col("old_text") != F.col("new_text")).otherwise(False))


def _in_pieces(rows, kind: pa.DataType, *columns: pa.Array, size: int = 64) -> pa.Array:
    """rows(values of the columns) for each row, of which only `size` at a time are Python's."""
    pieces = [pa.array([rows(*v) for v in zip(*(c.slice(i, size).to_pylist() for c in columns), strict=True)], kind) for i in range(0, len(columns[0]), size)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)


COUNTS = "array<struct<line:string,n:bigint>>"


def line_counts(old: pa.Array, new: pa.Array) -> pa.Array:
    def differing(x: str, y: str) -> list:
        n = Counter(y.split("\n"))
        n.subtract(x.split("\n"))
        return [{"line": k, "n": v} for k, v in n.items() if v]

    return _in_pieces(differing, pa.list_(pa.struct([("line", pa.string()), ("n", pa.int64())])), old, new)


def line_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(slug, line, removed, added): lines as multisets, only those whose counts differ. Lines are counted where the page is; only those that differ are shuffled."""
    ship(old.sparkSession)
    rows = changed_pairs(old, new).select("slug", F.explode(F.arrow_udf(line_counts, COUNTS)("old_text", "new_text")).alias("e")).select("slug", "e.line", "e.n")
    summed = rows.groupBy("slug", "line").agg(F.sum("n").alias("n")).where("n <> 0")
    return summed.select("slug", "line", F.greatest(-F.col("n"), F.lit(0)).alias("removed"), F.greatest("n", F.lit(0)).alias("added"))


HUNKS = "array<struct<op:string,old_lines:array<string>,new_lines:array<string>>>"


def hunk_lists(old: pa.Array, new: pa.Array) -> pa.Array:
    def aligned(x: str, y: str) -> list:
        a, b = x.splitlines(), y.splitlines()
        return [{"op": op, "old_lines": a[i1:i2], "new_lines": b[j1:j2]} for op, i1, i2, j1, j2 in alignment.opcodes(a, b) if op != "equal"]

    lines = pa.list_(pa.string())
    return _in_pieces(aligned, pa.list_(pa.struct([("op", pa.string()), ("old_lines", lines), ("new_lines", lines)])), old, new)


def page_hunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(slug, hunk, op, old_lines, new_lines) of changed pages in document order.

    The longest common block of lines is fixed first, then what lies before and after it in the same way; what
    is left between blocks is a hunk: insert, delete or replace. So lines that move are deleted in one place
    and inserted in another. Pages are aligned on their own row, and only those whose texts differ.
    """
    ship(old.sparkSession)
    found = changed_pairs(old, new).select("slug", F.posexplode(F.arrow_udf(hunk_lists, HUNKS)("old_text", "new_text")).alias("n", "h"))
    return found.select("slug", (F.col("n") + 1).alias("hunk"), "h.op", "h.old_lines", "h.new_lines")


def unified_diffs(old: DataFrame, new: DataFrame, names: tuple[str, str] = ("baseline", "current"), context: int = 3) -> DataFrame:
    """(slug, diff) of changed pages as unified diffs; `{slug}` in a name stands for the page. Pages whose lines are alike have none."""
    ship(old.sparkSession)
    return changed_pairs(old, new).select("slug", _diff_of(names, context)("slug", "old_text", "new_text").alias("diff")).where("diff <> ''")


def _diff_of(names: tuple[str, str], context: int = 3):
    """Unified diff of two texts of a slug, empty where their lines are alike; null where a text is."""

    @F.arrow_udf("string")
    def diff_of(slug: pa.Array, old_text: pa.Array, new_text: pa.Array) -> pa.Array:
        def diff(key, x: str | None, y: str | None) -> str | None:
            if x is None or y is None:
                return None
            a, b = x.splitlines(), y.splitlines()
            return alignment.unified(a, b, alignment.opcodes(a, b), tuple(n.replace("{slug}", str(key)) for n in names), context)

        return _in_pieces(diff, pa.string(), slug, old_text, new_text)

    return diff_of


def diff_text(hunks: DataFrame) -> DataFrame:
    """(slug, diff): removed and added lines of each page's hunks in order."""
    lines = F.concat(F.transform("old_lines", lambda x: F.concat(F.lit("-"), x)), F.transform("new_lines", lambda x: F.concat(F.lit("+"), x)))
    ordered = F.array_sort(F.collect_list(F.struct("hunk", F.array_join(lines, "\n").alias("t"))))
    return hunks.groupBy("slug").agg(F.array_join(ordered["t"], "\n").alias("diff"))


def fingerprint_hunks(hunks: DataFrame) -> DataFrame:
    """(slug, fingerprint): sha256 of a page's hunks in document order."""
    one = F.concat(F.col("op"), F.lit("|OLD:"), F.array_join("old_lines", "\n"), F.lit("|NEW:"), F.array_join("new_lines", "\n"))
    ordered = F.array_sort(F.collect_list(F.struct("hunk", one.alias("t"))))["t"]
    return hunks.groupBy("slug").agg(ordered.alias("t")).select("slug", X.sha256_hex(F.array_join(F.concat(F.array(F.concat(F.lit("slug="), F.col("slug"))), F.col("t")), "\n---\n")).alias("fingerprint"))


def with_tokens(df: DataFrame, text: Column, prefix: str = "") -> DataFrame:
    """Add one column of distinct tokens for each category; a claimed span is blanked before the next category looks.

    Each step is a column of its own, so the text is rewritten once for each category, and only where it
    holds what every token of that category has.
    """
    rest = f"__rest{prefix}"
    df = df.withColumn(rest, text)
    for category, pattern in TOKENS:
        pattern = UNICODE + pattern
        hits = F.regexp_extract_all(rest, F.lit(f"({pattern})"), F.lit(1))
        if category in ("address", "email"):
            hits = F.transform(hits, F.lower)
        elif category == "url":
            hits = F.transform(hits, lambda u: F.regexp_replace(u, r"[.,;:)]+$", ""))
        elif category == "number":
            hits = F.transform(hits, lambda n: F.replace(n, F.lit(","), F.lit("")))
        mark = MARKS.get(category)
        blank = F.regexp_replace(rest, pattern, " ")
        if mark:
            there = F.col(rest).contains(mark)
            hits, blank = F.when(there, hits).otherwise(F.when(F.col(rest).isNotNull(), F.array().cast("array<string>"))), F.when(there, blank).otherwise(F.col(rest))
        df = df.withColumns({f"{prefix}{category}": F.array_distinct(hits), f"{rest}_next": blank}).drop(rest).withColumnRenamed(f"{rest}_next", rest)
    return df.drop(rest)


def extract_tokens(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, category, token), each once."""
    found = with_tokens(df.select(key, F.col(text).alias("__text")), F.col("__text"), "__t_")
    entries = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"__t_{c}").alias("tokens")) for c, _ in TOKENS])
    return found.select(key, F.explode(entries).alias("e")).select(key, "e.category", F.explode("e.tokens").alias("token"))


def fact_value_index(facts: DataFrame) -> DataFrame:
    """(category, token, key, pos): every leaf of every known fact's value, as a token of its kind; pos orders a fact's leaves.

    A value that is a JSON object or list is opened three levels deep, all in one pass; other values are one
    leaf. Names of an object come in alphabetical order. Leaves of no kind, and nulls, are left out. A leaf keeps
    a row of its own for each fact row, and no key or token is gathered, so any number of facts may share a token.
    """
    opened = facts.where("value <> 'unknown'").select("key", "value", F.when(F.col("value").rlike(r"^\s*[\[{]"), F.try_parse_json("value")).alias("v"))
    # Whatever is no object or list gives one row without an entry.
    levels = facts.sparkSession.sql(
        """SELECT t.key, t.value, t.v, a.pos AS p1, b.pos AS p2, c.pos AS p3, coalesce(c.value, b.value, a.value) AS leaf
        FROM {opened} t, LATERAL variant_explode_outer(t.v) a, LATERAL variant_explode_outer(a.value) b, LATERAL variant_explode_outer(b.value) c""",
        opened=opened,
    )
    text = F.when(F.col("v").isNull(), F.col("value")).when(~F.schema_of_variant("leaf").rlike("^(OBJECT|ARRAY)"), F.trim(F.try_variant_get("leaf", "$", "string")))
    step = lambda c: F.coalesce(F.col(c) + 1, F.lit(0)).cast("bigint")
    leaves = levels.select("key", ((step("p1") * (1 << 20) + step("p2")) * (1 << 20) + step("p3")).alias("pos"), text.alias("leaf"))
    kind = F.lit(None).cast("string")
    for category, pattern in reversed(TOKENS):
        kind = F.when(F.col("leaf").rlike(rf"{UNICODE}^(?:{pattern})$"), category).otherwise(kind)
    token = F.when(F.col("category").isin("address", "email"), F.lower("leaf")).when(F.col("category") == "number", F.replace("leaf", F.lit(","), F.lit(""))).otherwise(F.col("leaf"))
    return leaves.withColumn("category", kind).where("category is not null").select("category", token.alias("token"), "key", "pos")


def _token_changes(hunks: DataFrame) -> DataFrame:
    """(slug, hunk, e): e is (category, change, token, n_added, one_added) of each token that a hunk removes or adds; null for a hunk without any.

    n_added and one_added are how many tokens of that kind the hunk adds, and the first of them.
    """
    found = with_tokens(with_tokens(hunks.select("slug", "hunk", "old_lines", "new_lines"), F.array_join("old_lines", "\n"), "__o_"), F.array_join("new_lines", "\n"), "__n_")
    found = found.withColumns({f"__a_{c}": F.array_except(f"__n_{c}", f"__o_{c}") for c, _ in TOKENS} | {f"__r_{c}": F.array_except(f"__o_{c}", f"__n_{c}") for c, _ in TOKENS})

    def entries(c: str, change: str, column: str) -> Column:
        added = F.col(f"__a_{c}")
        return F.transform(column, lambda t: F.struct(F.lit(c).alias("category"), F.lit(change).alias("change"), t.alias("token"), F.size(added).alias("n_added"), F.array_min(added).alias("one_added")))

    every = F.flatten(F.array(*[entries(c, change, f"{p}{c}") for c, _ in TOKENS for change, p in (("removed", "__r_"), ("added", "__a_"))]))
    return found.select("slug", "hunk", F.explode_outer(every).alias("e"))


def hunk_tokens(hunks: DataFrame) -> DataFrame:
    """(slug, hunk, category, token, change): tokens that a hunk removes or adds."""
    return _token_changes(hunks).where("e is not null").select("slug", "hunk", "e.category", "e.change", "e.token")


def hunk_facts(hunks: DataFrame, index: DataFrame, pieces: int = 8) -> DataFrame:
    """(slug, hunk, key, category, old_value, proposed): each fact a hunk touches; key is null in the one row more that a hunk may have, and in the only row of a hunk that touches none.

    Hunks and facts are read once each and meet in one join. The facts of a token are dealt to `pieces` by their
    keys, and each token of a hunk looks in all of them, so a token that a third of all facts have is spread over
    as many tasks, and a token of a third of all hunks over as many; Spark splits what is still skewed. See
    `propose_value` for the columns.
    """
    known = index.withColumn("piece", F.pmod(F.xxhash64("key"), F.lit(pieces)).cast("int"))
    dealt = _token_changes(hunks).select("slug", "hunk", F.col("e.category").alias("category"), F.col("e.token").alias("token"), "e.change", "e.n_added", "e.one_added")
    asked = dealt.withColumn("piece", F.explode(F.when(F.col("token").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(pieces - 1)))))
    met = asked.join(known.hint("merge"), ["category", "token", "piece"], "left")
    told = F.when((F.col("change") == "removed") & F.col("key").isNotNull(), F.struct("pos", "category", "token", "n_added", "one_added"))
    first = met.groupBy("slug", "hunk", "key").agg(F.min(told).alias("f"))
    return first.select("slug", "hunk", "key", F.col("f.category").alias("category"), F.col("f.token").alias("old_value"), F.when(F.col("f.n_added") == 1, F.col("f.one_added")).alias("proposed"))


def fact_classes(index: DataFrame, chunk: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(category, token, key, pos) of classes of facts, and (class, c, keys) with the keys of each, about `chunk` in a row.

    Facts with the same leaves are one class, as a hunk touches all of them or none and in the same way; `key` of
    the first is the class, an exclusive or of two 64-bit hashes of its leaves and the number n of rows that its keys are
    dealt to, c from 0. Neither leaves nor keys are gathered beyond a chunk, so any number of facts may be of one class;
    only classes of more than a chunk are broadcast, of which there is one at most for `chunk` facts.
    """
    leaves = index.where("key is not null").select("key", "category", "token", "pos").distinct()
    mixed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "category", "token", "pos"))
    hashed = leaves.groupBy("key").agg(mixed(0).alias("a"), mixed(1).alias("b"))
    large = hashed.groupBy("a", "b").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("n")).where("n > 1")
    of_key = hashed.join(F.broadcast(large), ["a", "b"], "left").select("key", F.struct("a", "b", F.coalesce("n", F.lit(1)).alias("n")).alias("class"))
    by_class = leaves.join(of_key.hint("merge"), "key").select("category", "token", F.col("class").alias("key"), "pos").distinct()
    dealt = of_key.select("class", "key", F.pmod(F.xxhash64("key"), "class.n").alias("c"))
    return by_class, dealt.groupBy("class", "c").agg(F.collect_list("key").alias("keys"))


def _with_keys(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows by class, each once for each row of keys that its class has.

    What is shuffled is small and what comes of it is not, so rows and keys are dealt to all shuffle partitions, which Spark
    leaves apart, and those of a large class to as many of them as it has rows of keys.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("class.n") - 1)))
    return asked.repartition(parts, "class", "c").join(members.repartition(parts, "class", "c").hint("merge"), ["class", "c"]).drop("c")


def _listed(rows: DataFrame, members: DataFrame, entry, kind: str, out: str, show=None) -> DataFrame:
    """Rows with `out` in place of their array `classes` of structs: the sorted entries of all keys of these classes, shown by `show`.

    Rows with the same classes have the same list, which is made once and joined to them; they are told apart by 128 bits.
    What is shuffled is small and what comes of it is not, so lists are dealt to all shuffle partitions, which Spark leaves apart.
    """
    show = show or (lambda x: x)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    list_id = F.when(F.size("classes") > 0, F.struct(F.xxhash64("classes").alias("a"), F.xxhash64(F.lit(1), "classes").alias("b")))
    marked = rows.withColumn("list_id", list_id)
    each = marked.where("list_id is not null").groupBy("list_id").agg(F.first("classes").alias("classes")).select("list_id", F.explode("classes").alias("e"))
    met = _with_keys(each.withColumn("class", F.col("e.class")), members).repartition(parts, "list_id").select("list_id", F.transform("keys", lambda k: entry(k, F.col("e"))).alias("part"))
    lists = met.groupBy("list_id").agg(F.sort_array(F.flatten(F.collect_list("part"))).alias("l")).select("list_id", show(F.col("l")).alias(out))
    return marked.drop("classes").repartition(parts, "list_id").join(lists.hint("merge"), "list_id", "left").withColumn(out, F.coalesce(out, show(F.array().cast(kind)))).drop("list_id")


def reconcile(hunks: DataFrame, index: DataFrame) -> DataFrame:
    """(slug, hunk, keys, unmapped): the facts whose values a hunk removes or adds. Where keys may be without bound, take the rows of `propose_value`.

    Hunks meet classes of facts; a list of keys is made once for all hunks with the same classes.
    """
    classes, members = fact_classes(index)
    touched = hunk_facts(hunks, classes).groupBy("slug", "hunk").agg(F.sort_array(F.collect_list(F.when(F.col("key").isNotNull(), F.struct(F.col("key").alias("class"))))).alias("classes"))
    keys = _listed(touched, members, lambda k, e: k, "array<string>", "keys")
    return keys.select("slug", "hunk", "keys", (F.size("keys") == 0).alias("unmapped"))


def propose_value(hunks: DataFrame, index: DataFrame) -> DataFrame:
    """(slug, hunk, key, category, old_value, proposed): the fact's first removed leaf, and the one added token of its kind.

    Several added tokens or none leave the proposal null, for manual review; so does a fact none of
    whose leaves is removed. Hunks meet classes of facts, whose keys are put in last.
    """
    classes, members = fact_classes(index)
    rows = hunk_facts(hunks, classes).where("key is not null").withColumnRenamed("key", "class")
    return _with_keys(rows, members).select("slug", "hunk", F.explode("keys").alias("key"), "category", "old_value", "proposed")


EDITS = "array<struct<key:string,old_value:string,proposed:string>>"


def _first_edits(hunks: DataFrame, classes: DataFrame) -> DataFrame:
    """(slug, class, e, hunks): a page's first edit of each class of facts, and the hunks that touch it; class is null for hunks that touch none."""
    rows = hunk_facts(hunks, classes).withColumnRenamed("key", "class")
    return rows.groupBy("slug", "class").agg(F.min(F.struct("hunk", "old_value", "proposed")).alias("e"), F.collect_set("hunk").alias("hunks"))


def _by_page(edits: DataFrame, name: str, total: Column) -> DataFrame:
    """(slug, n_hunks, unmapped, name): how many hunks a page has and how many of them touch no fact, and `total` of its rows of `_first_edits`."""
    numbers = lambda where: F.size(F.array_distinct(F.flatten(F.collect_list(F.when(where, F.col("hunks")))))).cast("bigint")
    page = edits.groupBy("slug").agg(numbers(F.lit(True)).alias("n_hunks"), numbers(F.col("class").isNotNull()).alias("n_mapped"), total.alias(name))
    return page.select("slug", "n_hunks", (F.col("n_hunks") - F.col("n_mapped")).alias("unmapped"), name)


def page_findings(hunks: DataFrame, index: DataFrame, *more: DataFrame, show=None) -> DataFrame:
    """(slug, n_hunks, unmapped, more, edits): a page's hunks without a fact, and one edit for each fact, from its first hunk, by key.

    Pages meet classes of facts; a list of edits is made once for all pages that edit the same classes in the same
    way, and shown by `show` if given. `more` are frames by slug, joined before the lists are. Where only the number
    of edits counts, take `finding_counts`.
    """
    classes, members = fact_classes(index)
    entries = F.sort_array(F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "e.old_value", "e.proposed"))))
    page = _by_page(_first_edits(hunks, classes), "classes", entries)
    for frame in more:
        page = page.join(frame.hint("merge"), "slug")
    edit = lambda k, e: F.struct(k.alias("key"), e["old_value"].alias("old_value"), e["proposed"].alias("proposed"))
    return _listed(page, members, edit, EDITS, "edits", show)


def finding_counts(hunks: DataFrame, index: DataFrame) -> DataFrame:
    """(slug, n_hunks, unmapped, n_edits): `page_findings` with how many edits a page has. Sizes of classes are added up, so no list of edits is made."""
    classes, members = fact_classes(index)
    sizes = members.groupBy("class").agg(F.sum(F.size("keys")).alias("n_keys"))
    return _by_page(_first_edits(hunks, classes).join(sizes.hint("merge"), "class", "left"), "n_edits", F.coalesce(F.sum("n_keys"), F.lit(0)))


def dedup_findings(findings: DataFrame, state: DataFrame) -> DataFrame:
    """New (slug, fingerprint, detected_at) only, each once at its first time; what the state has stays silent."""
    fresh = findings.join(state.select("slug", "fingerprint"), ["slug", "fingerprint"], "left_anti")
    return fresh.groupBy("slug", "fingerprint").agg(F.min("detected_at").alias("first_seen"))


def pages_with_commits(pages: DataFrame, commits: DataFrame, since) -> DataFrame:
    """Pages with a commit at or after the cursor."""
    return pages.join(commits.where(F.col("ts") >= since).select("path").distinct(), "path", "left_semi")


def next_cursor(commits: DataFrame) -> DataFrame:
    return commits.agg(F.max("ts").alias("cursor"))


def scope_parity(sitemap: DataFrame, tracked: DataFrame, noindex: DataFrame, excluded: DataFrame) -> DataFrame:
    """(kind, slug, fingerprint): pages to track, to drop, and excluded ones that the sitemap still lists."""
    expected = sitemap.select("slug").union(noindex.select("slug")).distinct().join(excluded, "slug", "left_anti")
    new = expected.join(tracked, "slug", "left_anti").select(F.lit("new_page").alias("kind"), "slug")
    gone = tracked.select("slug").distinct().join(expected, "slug", "left_anti").select(F.lit("removed_page").alias("kind"), "slug")
    still = sitemap.select("slug").distinct().join(excluded, "slug", "left_semi").select(F.lit("excluded_present").alias("kind"), "slug")
    rows = new.union(gone).union(still)
    return rows.withColumn("fingerprint", X.sha256_hex(F.concat("kind", F.lit(":"), "slug")))


def source_parity(live: DataFrame, repo: DataFrame, sentinels: DataFrame) -> DataFrame:
    """(slug, matches, diff) of sentinel pages in two sources; the diff leads from the repository's lines to the live ones.

    Pages match if their lines are alike in order; of a text that is null neither is known. A slug that a source has
    several times gives a row for each pair of its pages. Only texts that differ go to Python.
    """
    ship(live.sparkSession)
    named = sentinels.select("slug").distinct()
    a, b = (x.join(named, "slug", "left_semi").select("slug", F.col("text").alias(name)) for x, name in ((live, "live"), (repo, "repo")))
    differ = F.col("repo") != F.col("live")
    sides = (F.when(differ, F.col(c)) for c in ("repo", "live"))
    pairs = b.join(a, "slug").select("slug", differ.alias("differ"), _diff_of(("repo:{slug}", "live:{slug}"))("slug", *sides).alias("diff"))
    return pairs.select("slug", F.when(F.col("differ"), F.col("diff") == "").otherwise(~F.col("differ")).alias("matches"), F.nullif("diff", F.lit("")).alias("diff"))


def advance_baseline(base: DataFrame, current: DataFrame, accepted: DataFrame) -> DataFrame:
    """Baseline after accepted findings (slug, fingerprint): their pages take the current text. One that is given twice counts once; of pages that share a slug, give only texts that were accepted."""
    new = accepted.select("slug", "fingerprint").distinct().join(current.select("slug", F.col("text").alias("new_text")), "slug")
    joined = base.join(new, "slug", "left")
    text = F.coalesce("new_text", "text")
    stamp = F.when(F.col("new_text").isNull(), F.col("seeded_from")).otherwise(F.concat(F.lit("pr:"), F.col("fingerprint")))
    return joined.select("slug", text.alias("text"), X.sha256_hex(text).alias("sha256"), stamp.alias("seeded_from"))


def finding_batch_summary(counts: DataFrame) -> DataFrame:
    """One row of `finding_counts`: pages, edits and unmapped hunks. The slugs stay rows: a list of all would not be bounded."""
    return counts.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("n_edits"), F.lit(0)).alias("edits"), F.coalesce(F.sum("unmapped"), F.lit(0)).alias("unmapped"))


def edit_lines(edits: Column) -> Column:
    """A page's edits as lines of a report."""
    return F.array_join(F.transform(edits, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["old_value"], F.lit("?")), F.lit(" -> "), F.coalesce(e["proposed"], F.lit("manual review")))), "\n")


def report_rows(findings: DataFrame, stamp: str, lines: Column | None = None) -> DataFrame:
    """(slug, file_name, body): one markdown report for each finding (slug, fingerprint, diff, edits, unmapped); `lines` is the text of its edits where that is made already."""
    lines = edit_lines(F.col("edits")) if lines is None else lines
    body = F.concat_ws("\n", F.concat(F.lit("# Drift: "), "slug"), F.concat(F.lit("fingerprint "), "fingerprint"), F.concat(F.lit("unmapped hunks "), F.col("unmapped").cast("string")), lines, F.lit("```diff"), F.col("diff"), F.lit("```"))
    name = F.concat(F.lit(f"{stamp}-"), F.regexp_replace("slug", "[^A-Za-z0-9_-]+", "-"), F.lit("-"), F.substring("fingerprint", 1, 12), F.lit(".md"))
    return findings.select("slug", name.alias("file_name"), body.alias("body"))
