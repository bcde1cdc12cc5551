"""Messages: gating, intents, guardrails, rendering and packing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import exprs as X

UPDATE = "update_id bigint, message struct<message_id:bigint, from:struct<id:bigint, language_code:string>, chat:struct<id:bigint, type:string>, date:bigint, text:string, entities:array<struct<type:string, offset:int, length:int>>>"
# How an answer begins that is a refusal.
REFUSALS = (
    r"i\s+don'?t\s+know\b", r"i\s+do\s+not\s+know\b", r"i\s+don'?t\s+have\b", r"i\s+do\s+not\s+have\b", r"i\s+can'?t\b", r"i\s+cannot\b", r"i'?m\s+not\s+able\b", r"i\s+am\s+not\s+able\b", r"i'?m\s+unable\b", r"i\s+am\s+unable\b",
    r"sorry,?\s+i\s+(?:don'?t|do\s+not|can'?t|cannot)\b", r"unfortunately,?\s+i\s+(?:don'?t|do\s+not|can'?t|cannot)\b",
)
# Wording that solicits or promises a yield.
SOLICITATION = (
    r"\byou should (?:buy|purchase|invest)\b", r"\bwe recommend (?:buying|purchasing|investing)\b", r"\b(?:great|good|perfect|best|ideal) time to (?:buy|invest)\b", r"\bdon'?t miss (?:out|this)\b", r"\bact now\b",
    r"\bbuy (?:now|today)\b", r"\bstrong buy\b", r"\bguaranteed (?:returns?|profits?|gains?)\b", r"\b(?:excellent|amazing|can'?t[- ]miss) investment\b", r"\bnow is the time\b",
)
YIELD = (r"\b\d+(?:\.\d+)?\s*%\s*(?:apy|apr|annual (?:yield|return|percentage)|per year)\b", r"\byield of \d+(?:\.\d+)?\s*%")


@dataclass
class Rules:
    """Rule tables, all parameters: token sets, patterns, terms and links."""

    commands: Sequence[str] = ()
    supply: Sequence[str] = ()
    price: Sequence[str] = ()
    listing: Sequence[str] = ()
    exchange: Sequence[str] = ()
    timing: Sequence[str] = ()
    buy: Sequence[str] = ()
    buy_object: Sequence[str] = ()
    holder: Sequence[str] = ()
    smalltalk: str = r"a^"
    greetings: Sequence[str] = ()
    fillers: Sequence[str] = ()
    intro: str = r"a^"
    banned_figures: Sequence[str] = ()
    banned_terms: Sequence[str] = ()
    brand: str = ""
    brand_patterns: Sequence[str] = ()
    link_prefixes: Sequence[str] = ()
    api_hosts: dict[str, str] = field(default_factory=dict)
    site: str = ""
    refusal: str = "I can't help with that."


def translate_updates(updates: DataFrame, payload: str, bot: str) -> DataFrame:
    """Chat updates as messages: text only; in groups only what addresses the bot, in private all."""
    u = updates.select(F.from_json(payload, UPDATE).alias("u")).where("u.message.text is not null")
    m = F.col("u.message")
    entities = F.coalesce(m["entities"], F.array().cast("array<struct<type:string,offset:int,length:int>>"))
    text = m["text"]
    command = F.exists(entities, lambda e: (e["type"] == "bot_command") & (e["offset"] == 0))
    length = F.element_at(F.filter(entities, lambda e: (e["type"] == "bot_command") & (e["offset"] == 0)), 1)["length"]
    mention = F.exists(entities, lambda e: (e["type"] == "mention") & (F.lower(F.substring(text, e["offset"] + 1, e["length"])) == "@" + bot.lower()))
    dm = m["chat"]["type"] == "private"
    named = mention | F.lower(text).contains("@" + bot.lower())
    name = F.when(command, F.lower(F.substring_index(F.substring(text, F.lit(2), length - 1), "@", 1)))
    rows = u.select(
        m["chat"]["id"].cast("string").alias("chat_id"), F.coalesce(m["from"]["id"], m["chat"]["id"]).cast("string").alias("user_id"), m["message_id"].cast("string").alias("message_id"),
        text.alias("text"), dm.alias("is_dm"), (dm | command | named).alias("mentioned"), name.alias("command"), m["from"]["language_code"].alias("locale"), X.epoch_iso(m["date"]).alias("ts"),
    )
    return rows.where("mentioned")


def detect_command(messages: DataFrame, commands: Sequence[str], native: str | None = None, text: str = "text") -> DataFrame:
    """Add command and args; a native command wins, an unknown one is help, plain text has none."""
    pattern = r"(?s)^/(\w+)(?:@\w+)?\s*(.*)$"
    parsed = F.nullif(F.lower(F.regexp_extract(text, pattern, 1)), F.lit(""))
    name = F.coalesce(F.col(native), parsed) if native else parsed
    known = F.when(name.isNull(), None).when(name.isin(list(commands)), name).otherwise("help")
    return messages.withColumn("command", known).withColumn("args", F.when(F.col("command").isNotNull(), F.regexp_extract(text, pattern, 2)))


def is_non_latin(text: str | Column) -> Column:
    """More than half of the letters are of other scripts; without letters false."""
    c = F.col(text) if isinstance(text, str) else text
    letters = F.length(F.regexp_replace(c, r"\P{L}", ""))
    latin = F.length(F.regexp_replace(c, r"\P{IsLatin}", ""))
    return F.coalesce((letters > 0) & ((letters - latin) / letters > 0.5), F.lit(False))


def _set(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def token_intents(tokens: Column, r: Rules) -> dict[str, Column]:
    """Flags of the token rules."""
    any_of = lambda words: F.arrays_overlap(tokens, _set(words)) if words else F.lit(False)
    return {
        "supply": any_of(r.supply), "price": any_of(r.price), "listing": any_of(r.listing) | (any_of(r.exchange) & any_of(r.timing)),
        "buy": any_of(r.buy) & any_of(r.buy_object), "holder": any_of(r.holder),
    }


def pattern_intents(text: Column, tokens: Column, r: Rules) -> dict[str, Column]:
    """Flags of the pattern rules: small talk or a short greeting, and introductions."""
    greeting = (F.size(tokens) <= 4) & F.arrays_overlap(tokens, _set(r.greetings)) & (F.size(F.array_except(tokens, _set([*r.greetings, *r.fillers]))) == 0)
    return {"offtopic": text.rlike(r.smalltalk) | greeting, "intro": text.rlike(r.intro)}


def route_intent(messages: DataFrame, r: Rules, text: str = "text", maintenance: Column | None = None) -> DataFrame:
    """Add intent; the first that holds wins: maintenance, command, empty, other script, off topic, the token intents, intro, else search."""
    m = detect_command(messages, r.commands, text=text).withColumn("__t", X.word_tokens(text))
    c, t = F.col(text), F.col("__t")
    flags = token_intents(t, r) | pattern_intents(c, t, r)
    chain = F.when(maintenance if maintenance is not None else F.lit(False), "maintenance").when(F.col("command").isNotNull(), "command").when(F.trim(c) == "", "empty").when(is_non_latin(c), "non_english")
    for name in ("offtopic", "supply", "price", "listing", "buy", "holder", "intro"):
        chain = chain.when(flags[name], "price" if name in ("listing", "buy") else name)
    return m.withColumn("intent", chain.otherwise("search")).drop("__t", "args")


def extract_numbers(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, number), normalised, each once."""
    return df.select(key, F.explode_outer(X.numbers_in(text)).alias("number")).where("number is not null")  # an inner explode would look twice


def unsourced_numbers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(conv_id, turn, number): numbers of an answer that no earlier source of its conversation has.

    Both are (conv_id, turn, text). Sources are reduced to each number's first turn before they join.
    """
    a = answers.select("conv_id", "turn", F.explode(X.numbers_in("text")).alias("number"))
    s = sources.select("conv_id", "turn", F.explode(X.numbers_in("text")).alias("number")).groupBy("conv_id", "number").agg(F.min("turn").alias("first"))
    joined = a.join(s, ["conv_id", "number"], "left")
    return joined.where(F.col("first").isNull() | (F.col("first") >= F.col("turn"))).select("conv_id", "turn", "number")


def policy_rules(r: Rules) -> list[tuple[str, str]]:
    """(family, pattern) of all rules; a figure counts with a number's edges and not before a percent sign."""
    figure = [rf"(?<![\d.])\$?{f.replace('.', chr(92) + '.')}(?!\d)(?!\s*%)" for f in r.banned_figures]
    return [("solicitation", "(?i)" + p) for p in SOLICITATION] + [("yield", "(?i)" + p) for p in YIELD] + [("figure", p) for p in figure] + [("term", rf"(?i)\b{t}\b") for t in r.banned_terms]


def violations(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Array of (family, pattern) that a text breaks."""
    every = F.array(*[F.when(text.rlike(p), F.struct(F.lit(f).alias("family"), F.lit(p).alias("pattern"))) for f, p in rules])
    return F.filter(every, lambda x: x.isNotNull())


def policy_violations(df: DataFrame, rules: list[tuple[str, str]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, family, pattern): one row for each broken rule; rules are few and tested in one projection."""
    return df.select(key, F.explode(violations(F.col(text), rules)).alias("v")).select(key, "v.family", "v.pattern")


def is_refusal(text: str | Column, patterns: Sequence[str] = REFUSALS) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.trim(c).rlike("(?i)^(?:" + "|".join(patterns) + ")"), F.lit(False))


def normal_terms(text: Column, r: Rules) -> Column:
    """Spellings of the brand as the canonical one, but in urls, mail addresses and link targets."""
    parts = F.regexp_extract_all(text, F.lit(r"(\]\([^)]*\)|(?:(?!\]\()\S)+|\s+)"), F.lit(1))

    def fix(w: Column) -> Column:
        out = w
        for p in r.brand_patterns:
            out = F.regexp_replace(out, p, r.brand)
        return F.when(w.contains("://") | w.contains("@") | w.startswith("]("), w).otherwise(out)

    return F.array_join(F.transform(parts, fix), "")


def normalize_terms(df: DataFrame, cols: Sequence[str], r: Rules) -> DataFrame:
    return df.withColumns({c: normal_terms(F.col(c), r) for c in cols})


def _allowed(url: Column, prefixes: Sequence[str]) -> Column:
    test = F.lit(False)
    for p in prefixes:
        test = test | url.startswith(p)
    return test


def filter_links(responses: DataFrame, items: str, prefixes: Sequence[str]) -> DataFrame:
    """Links with an allowed prefix; add dropped, the urls that go."""
    kept = F.filter(items, lambda x: _allowed(x["url"], prefixes))
    dropped = F.transform(F.filter(items, lambda x: ~_allowed(x["url"], prefixes)), lambda x: x["url"])
    return responses.withColumn("dropped", dropped).withColumn(items, kept)


def safe_source(source: Column, r: Rules) -> Column:
    """An API path of an official host as that host's page, an allowed link as it is, all else as the site."""
    out = F.when(_allowed(source, r.link_prefixes), source).otherwise(F.lit(r.site))
    for prefix, page in r.api_hosts.items():
        out = F.when(source.startswith(prefix), page).otherwise(out)
    return out


def sanitize_sources(df: DataFrame, source: str, r: Rules) -> DataFrame:
    """A fact's source: an API path of an official host is that host's page, an allowed link stays, all else is the site."""
    return df.withColumn(source, safe_source(F.col(source), r))


def enforce(responses: DataFrame, r: Rules, text: str = "text", items: str = "items") -> DataFrame:
    """Normalised text checked against the policy; a broken rule replaces the whole answer; then links are filtered."""
    clean = normalize_terms(responses, [text], r).withColumn("violations", violations(F.col(text), policy_rules(r)))
    bad = F.size("violations") > 0
    none = F.slice(items, 1, 0)
    safe = clean.withColumn(text, F.when(bad, r.refusal).otherwise(F.col(text))).withColumn(items, F.when(bad, none).otherwise(F.col(items)))
    return filter_links(safe, items, r.link_prefixes)


def apply_maintenance(messages: DataFrame, control: DataFrame, default: str) -> DataFrame:
    """Add notice: the control row's text, the default where it is empty, null without a row. Control has one row at most."""
    one = control.limit(1).select(F.coalesce(F.nullif("message", F.lit("")), F.lit(default)).alias("notice"))
    return messages.join(F.broadcast(one), F.lit(True), "left")


BLOCK = "struct<type:string,text:string,label:string,value:string,source:string,as_of:string,items:array<struct<label:string,url:string>>>"


ITEMS = "array<struct<label:string,url:string>>"
LISTS = ("links", "buttons")
PROSE = ("heading", "paragraph", "warning")


def typed_block(**fields: Column) -> Column:
    """A block struct; fields that are not given are null."""
    parts = [fields.get(n, F.lit(None)).cast(ITEMS if n == "items" else "string").alias(n) for n in ("type", "text", "label", "value", "source", "as_of", "items")]
    return F.struct(*parts)


def normal_block(b: Column, r: Rules) -> Column:
    """A block with the brand's spelling in what is read: text, a fact's label and value, labels of links and buttons."""
    kind = b["type"]
    prose, fact = kind.isin(*PROSE), kind == "fact"
    items = F.transform(b["items"], lambda i: F.struct(normal_terms(i["label"], r).alias("label"), i["url"].alias("url")))
    pick = lambda test, name: F.when(test, normal_terms(b[name], r)).otherwise(b[name])
    return typed_block(type=kind, text=pick(prose, "text"), label=pick(fact, "label"), value=pick(fact, "value"), source=b["source"], as_of=b["as_of"], items=F.when(kind.isin(*LISTS), items).otherwise(b["items"]))


def blocks_text(blocks: Column) -> Column:
    """All that a response says, a line for each text, fact and label, as the policy reads it."""
    def said(b: Column) -> Column:
        return (
            F.when(b["type"].isin(*PROSE), F.array(b["text"])).when(b["type"] == "fact", F.array(F.concat_ws(" ", b["label"], b["value"])))
            .when(b["type"].isin(*LISTS), F.transform(b["items"], lambda i: i["label"])).otherwise(F.array().cast("array<string>"))
        )

    return F.array_join(F.flatten(F.filter(F.transform(blocks, said), lambda x: x.isNotNull())), "\n")


def allowed_block(b: Column, r: Rules) -> Column:
    """A block with a safe source and allowed links only; null for links or buttons of which none is left."""
    lists = b["type"].isin(*LISTS)
    kept = F.filter(b["items"], lambda i: F.coalesce(_allowed(i["url"], r.link_prefixes), F.lit(False)))
    source = F.when(b["type"] == "fact", safe_source(b["source"], r)).otherwise(b["source"])
    whole = typed_block(type=b["type"], text=b["text"], label=b["label"], value=b["value"], source=source, as_of=b["as_of"], items=F.when(lists, kept).otherwise(b["items"]))
    return F.when(~lists | (F.size(kept) > 0), whole)


def enforce_blocks(responses: DataFrame, r: Rules, blocks: str = "blocks") -> DataFrame:
    """A whole response of typed blocks behind the gate; add violations, the (family, pattern) that it breaks, and dropped, the urls that go.

    The brand is spelled first, then all that is said is held against the policy at once: where a rule is broken
    the response is a warning and a link to the site. Else sources are made safe, links that are not allowed go,
    and blocks that lose all their links go with them. Links never decide on a refusal. A null response is an
    empty one; a null block goes, and a type that is not known stays, for rendering to refuse.
    """
    rules = policy_rules(r)
    given = F.filter(F.coalesce(F.col(blocks), F.array().cast(f"array<{BLOCK}>")), lambda b: b.isNotNull())
    spelled = responses.withColumn(blocks, F.transform(given, lambda b: normal_block(b, r))).withColumn("__said", blocks_text(F.col(blocks)))
    judged = spelled.withColumn("violations", violations(F.col("__said"), rules))
    refusal = F.array(typed_block(type=F.lit("warning"), text=F.lit(r.refusal)), typed_block(type=F.lit("links"), items=F.array(F.struct(F.lit(r.brand).alias("label"), F.lit(r.site).alias("url")))))
    kept = F.filter(F.transform(blocks, lambda b: allowed_block(b, r)), lambda b: b.isNotNull())
    listed = F.flatten(F.transform(F.filter(blocks, lambda b: b["type"].isin(*LISTS) & b["items"].isNotNull()), lambda b: b["items"]["url"]))
    bad = F.size("violations") > 0
    gone = F.filter(listed, lambda u: ~F.coalesce(_allowed(u, r.link_prefixes), F.lit(False)))
    return judged.withColumn("dropped", F.when(bad, F.slice(gone, 1, 0)).otherwise(gone)).withColumn(blocks, F.when(bad, refusal).otherwise(kept)).drop("__said")


def render_markdown(md: Column) -> Column:
    """The small markdown subset with every other mark escaped: code, links, bold and italic spans keep their meaning."""
    parts = F.regexp_extract_all(md, F.lit(r"(`[^`]*`|\[[^\]]+\]\([^)]+\)|\*\*[^*]+?\*\*|\*[^*]+?\*|(?s:.))"), F.lit(1))

    def one(p: Column) -> Column:
        label, url = F.regexp_extract(p, r"^\[([^\]]+)\]", 1), F.regexp_extract(p, r"\]\(([^)]+)\)$", 1)
        inner = lambda n: F.substring(p, F.lit(n + 1), F.length(p) - 2 * n)
        return (
            F.when(p.rlike(r"^`[^`]*`$"), F.concat(F.lit("`"), X.escape_code(inner(1)), F.lit("`")))
            .when(p.rlike(r"^\[[^\]]+\]\([^)]+\)$"), F.concat(F.lit("["), X.escape_text(label), F.lit("]("), X.escape_link(url), F.lit(")")))
            .when(p.rlike(r"^\*\*[^*]+\*\*$"), F.concat(F.lit("*"), X.escape_text(inner(2)), F.lit("*")))
            .when(p.rlike(r"^\*[^*]+\*$"), F.concat(F.lit("_"), X.escape_text(inner(1)), F.lit("_")))
            .otherwise(X.escape_text(p))
        )

    return F.array_join(F.transform(parts, one), "")


def render_block(b: Column) -> Column:
    """A typed block as text; buttons render to nothing, and a type that is not known is an error."""
    links = F.array_join(F.transform(b["items"], lambda i: F.concat(F.lit("["), X.escape_text(i["label"]), F.lit("]("), X.escape_link(i["url"]), F.lit(")"))), "\n")
    fact = F.concat(F.lit("*"), X.escape_text(b["label"]), F.lit("*\n"), X.escape_text(b["value"]), F.lit("\nSource: ["), X.escape_text(b["source"]), F.lit("]("), X.escape_link(b["source"]), F.lit(")\nAs of "), X.escape_text(b["as_of"]))
    return (
        F.when(b["type"] == "heading", F.concat(F.lit("*"), X.escape_text(b["text"]), F.lit("*"))).when(b["type"] == "paragraph", render_markdown(b["text"])).when(b["type"] == "fact", fact)
        .when(b["type"] == "links", links).when(b["type"] == "warning", F.concat(F.lit("⚠️ *Warning:* "), render_markdown(b["text"])))
        .when(b["type"] == "buttons", "").otherwise(F.raise_error(F.concat(F.lit("unknown block type "), F.coalesce(b["type"], F.lit("null")))))
    )


def render_blocks(responses: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Add rendered, the non-empty texts of the blocks in order, and buttons, the (label, url) of all button blocks in order."""
    pressed = F.flatten(F.transform(F.filter(blocks, lambda b: b["type"] == "buttons"), lambda b: F.transform(b["items"], lambda i: F.struct(i["label"].alias("label"), i["url"].alias("url")))))
    return responses.withColumns({"rendered": F.filter(F.transform(blocks, render_block), lambda t: t != ""), "buttons": pressed})


def pack_messages(rendered: DataFrame, texts: str = "rendered", limit: int = 4096) -> DataFrame:
    """Add parts: texts joined by blank lines up to `limit` characters; one text is never cut; empty ones are left out; no text is one empty part.

    There is always a part: explode them by `explode_outer`, as an inner explode renders again to test for emptiness.

    Where there is a column `buttons`, messages is added too: each part as (text, buttons), all buttons with the last.
    """
    whole = F.filter(F.coalesce(F.col(texts), F.array().cast("array<string>")), lambda t: t != "")
    start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("used"))

    def fold(acc: Column, t: Column) -> Column:
        n = F.length(t)
        fresh = (acc["i"] == 0) | (acc["used"] + 2 + n > limit)
        return F.struct(F.when(fresh, F.array_append(acc["starts"], acc["i"] + 1)).otherwise(acc["starts"]).alias("starts"), (acc["i"] + 1).alias("i"), F.when(fresh, n).otherwise(acc["used"] + 2 + n).alias("used"))

    # Lengths alone decide where a part begins, so no text is copied before its part is cut out.
    laid = rendered.withColumn("__texts", whole).withColumn("__starts", F.aggregate("__texts", start, fold, lambda acc: acc["starts"]))
    end = lambda i: F.coalesce(F.get("__starts", i + 1), F.size("__texts") + 1)
    cut = F.transform("__starts", lambda s, i: F.array_join(F.slice("__texts", s, end(i) - s), "\n\n"))
    packed = laid.withColumn("parts", F.when(F.size("__starts") == 0, F.array(F.lit(""))).otherwise(cut)).drop("__texts", "__starts")
    if "buttons" not in rendered.columns:
        return packed
    last = lambda i: i == F.size("parts") - 1
    return packed.withColumn("messages", F.transform("parts", lambda t, i: F.struct(t.alias("text"), F.when(last(i), F.col("buttons")).otherwise(F.slice("buttons", 1, 0)).alias("buttons"))))


def chat_context(turns: DataFrame, n: int = 3) -> DataFrame:
    """(user_id, context): the newest n turns of each user, newest first. turns (user_id, seq, message, response)."""
    order = Window.partitionBy("user_id").orderBy(F.desc("seq"))
    newest = turns.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    one = F.concat(F.lit("User: "), "message", F.lit("\nBot: "), "response")
    return newest.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("r", one.alias("t"))))["t"], "\n").alias("context"))


def match_topics(messages: DataFrame, topics: dict[str, Sequence[str]], sections: DataFrame, related: dict[str, Sequence[str]]) -> DataFrame:
    """(query_id, topic, primary, content): topics whose keyword a message contains, then theirs one hop on; primary wins.

    Topics are a short configured table, so keyword tests are one projection.
    """
    lower = F.lower("text")
    hits = F.array(*[F.when(F.exists(_set(words), lambda w: lower.contains(w)), F.lit(t)) for t, words in topics.items()])
    primary = messages.select("query_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("topic"))
    hop = F.lit(None).cast("array<string>")
    for t, others in related.items():
        hop = F.when(F.col("topic") == t, _set(others)).otherwise(hop)
    second = primary.select("query_id", F.explode(hop).alias("topic"))
    both = primary.withColumn("primary", F.lit(True)).unionByName(second.withColumn("primary", F.lit(False)))
    one = both.groupBy("query_id", "topic").agg(F.max("primary").alias("primary"))
    return one.join(sections.select("topic", "content"), "topic").select("query_id", "topic", "primary", "content")


def repeated_within(requests: DataFrame, ttl_s: int, key: Sequence[str] = ("key",)) -> DataFrame:
    """(key, seq, age_us, hit): the time since the request before of the same key, and whether a kept answer would serve.

    An analysis of a request log, by event time. requests have us (microseconds) and seq, which parts equal
    times. Each day of a key is ordered on its own, and the last request of the day before it comes from
    a window over days, so one busy key is not one task.
    """
    day = F.floor(F.col("us") / 86_400_000_000)
    dealt = requests.select(*key, "us", "seq", day.alias("day"))
    last = dealt.groupBy(*key, "day").agg(F.max("us").alias("last"))
    before = last.select(*key, "day", F.lag("last").over(Window.partitionBy(*key).orderBy("day")).alias("before"))
    within = F.lag("us").over(Window.partitionBy(*key, "day").orderBy("us", "seq"))
    aged = dealt.withColumn("within", within).join(before, [*key, "day"])
    age = F.col("us") - F.coalesce("within", "before")
    return aged.select(*key, "seq", age.alias("age_us"), F.coalesce(age < ttl_s * 1_000_000, F.lit(False)).alias("hit"))


def admit_broadcasts(requests: DataFrame, rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Add accepted and an id made of the request's content, so a replay admits it as the same."""
    bad = F.size(violations(F.col(text), rules)) > 0
    return requests.withColumn("accepted", ~bad).withColumn("broadcast_id", F.when(~bad, F.substring(F.sha2(F.concat_ws("|", F.col("request_id").cast("string"), text), 256), 1, 32)))


def fan_out(accepted: DataFrame, chats: DataFrame) -> DataFrame:
    """(broadcast_id, channel, chat): null targets mean every configured chat; chats are a short configured list."""
    t, c = accepted.alias("t"), F.broadcast(chats.alias("c"))
    on = (F.col("t.channel").isNull() | (F.col("t.channel") == F.col("c.channel"))) & (F.col("t.chat").isNull() | (F.col("t.chat") == F.col("c.chat")))
    return t.where("t.accepted").join(c, on).select("t.broadcast_id", "c.channel", "c.chat")


def answer_quality(df: DataFrame, terms: Sequence[str], pairs: Sequence[tuple[str, str]], text: str = "text", min_len: int = 100, min_terms: int = 2) -> DataFrame:
    """Add n_terms, contradicts and good: long enough, enough terms and no pair of opposites."""
    lower = F.lower(text)
    n = F.size(F.filter(_set(terms), lambda t: lower.contains(t)))
    clash = F.lit(False)
    for a, b in pairs:
        clash = clash | (lower.contains(a) & lower.contains(b))
    return df.withColumns({"n_terms": n, "contradicts": clash, "good": (F.length(text) >= min_len) & (n >= min_terms) & ~clash})
