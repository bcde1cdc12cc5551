"""Queries of the messages lane: conversation turns stand in for messages and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from groundwork.functions import exprs as X
from groundwork.operators import messages as M
from groundwork.plans.registry import Registry
from groundwork.sources.files import table

lane = Registry()
QUERIES, ORACLE, query = lane.QUERIES, lane.ORACLE, lane.query

RULES = M.Rules(
    commands=("help", "price", "start"), supply=("supply", "circulating"), price=("price", "worth"), listing=("listed",), exchange=("exchange",), timing=("when", "soon"), buy=("buy",), buy_object=("token",),
    holder=("holders",), smalltalk=r"(?i)\b(?:tell me a joke|how are you)\b", greetings=("hi", "hello"), fillers=("there", "all"), intro=r"(?i)\bwhat is (?:acme|this project)\b",
    banned_figures=("0.25",), banned_terms=("pre-?sales?",), brand="Acme", brand_patterns=(r"(?i)\bacme\b", r"(?i)\bac-me\b"), link_prefixes=("https://docs.example.com/",),
    api_hosts={"https://api.example.com/": "https://example.com"}, site="https://example.com/home",
)
# Fixed endings that turn the invented prose into messages of every kind, by conversation and turn.
ENDINGS = ("what is the circulating supply", "when is it on an exchange", "buy the token", "how many holders", "what is acme", "tell me a joke", "is it listed", "you should buy now", "pays 12% apy today", "costs $0.25 or 0.25%", "old pre-sale of AC-ME", "see www.acme.io and https://acme.io/x")


def _turns(spark, sf_dir, role: str | None = None):
    c = table(spark, sf_dir, "conversations")
    return c.where(F.col("role") == role) if role else c


PICK = "(conv_id * 5 + turn * 3)"


def _messages(spark, sf_dir):
    pick = F.expr(f"{PICK} % 15")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), F.least(pick + 1, F.lit(len(ENDINGS))).cast("int"))
    text = F.when(pick == 12, F.lit("hello there")).when(pick == 13, F.lit("  ")).when(pick == 14, F.concat(F.lit("/Price@bot "), "text")).otherwise(F.concat("text", F.lit(" "), ending))
    return _turns(spark, sf_dir, "user").select("conv_id", "turn", text.alias("text"))


LIST = "[" + ", ".join("'" + e.replace("'", "''") + "'" for e in ENDINGS) + "]"
MESSAGES_SQL = f"msgs AS (SELECT conv_id, turn, CASE {PICK} % 15 WHEN 12 THEN 'hello there' WHEN 13 THEN '  ' WHEN 14 THEN '/Price@bot ' || text ELSE text || ' ' || ({LIST})[{PICK} % 15 + 1] END AS text FROM conversations WHERE role = 'user')"


@query("f1_translate_updates", """WITH b AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 1 AND turn % 2 = 0 THEN '/help@acme ' || text WHEN conv_id % 3 = 2 AND turn % 4 = 0 THEN 'ping @ACME ' || text ELSE text END AS text FROM conversations WHERE role = 'user'),
u AS (SELECT json_object('message_id', turn, 'from', json_object('id', conv_id * 10 + 1), 'chat', json_object('id', conv_id, 'type', CASE WHEN conv_id % 3 = 0 THEN 'private' ELSE 'group' END), 'date', turn + 1700000000, 'text', text, 'command_length', CASE WHEN starts_with(text, '/help@acme ') THEN 10 END) AS m FROM b),
x AS (SELECT *, m->>'$.text' AS text, (m->>'$.command_length')::INT AS n, (m->>'$.chat.type') = 'private' AS is_dm FROM u)
SELECT m->>'$.chat.id' AS chat_id, m->>'$.from.id' AS user_id, m->>'$.message_id' AS message_id, text, is_dm, CASE WHEN n IS NOT NULL THEN lower(split_part(substr(text, 2, n - 1), '@', 1)) END AS command, strftime(make_timestamp((m->>'$.date')::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM x WHERE text IS NOT NULL AND (is_dm OR n IS NOT NULL OR contains(lower(text), '@acme'))""")
def f1(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    command = (c % 3 == 1) & (t % 2 == 0)
    entity = F.when(command, F.array(F.struct(F.lit("bot_command").alias("type"), F.lit(0).alias("offset"), F.lit(10).alias("length"))))
    text = F.when(command, F.concat(F.lit("/help@acme "), "text")).when((c % 3 == 2) & (t % 4 == 0), F.concat(F.lit("ping @ACME "), "text")).otherwise(F.col("text"))
    chat = F.struct(c.alias("id"), F.when(c % 3 == 0, "private").otherwise("group").alias("type"))
    body = F.to_json(F.struct(t.alias("update_id"), F.struct(t.alias("message_id"), F.struct((c * 10 + 1).alias("id")).alias("from"), chat.alias("chat"), (t + 1700000000).alias("date"), text.alias("text"), entity.alias("entities")).alias("message")))
    return M.translate_updates(_turns(spark, sf_dir, "user").select(body.alias("payload")), "payload", "acme").select("chat_id", "user_id", "message_id", "text", "is_dm", "command", "ts")


@query("f2_detect_command", f"WITH {MESSAGES_SQL}, p AS (SELECT *, nullif(lower(regexp_extract(text, '(?s)^/(\\w+)(?:@\\w+)?\\s*(.*)$', 1)), '') AS c FROM msgs) SELECT conv_id, turn, CASE WHEN c IS NULL THEN NULL WHEN c IN ('help','price','start') THEN c ELSE 'help' END AS command, CASE WHEN c IS NOT NULL THEN regexp_extract(text, '(?s)^/(\\w+)(?:@\\w+)?\\s*(.*)$', 2) END AS args FROM p")
def f2(spark, sf_dir):
    return M.detect_command(_messages(spark, sf_dir), RULES.commands).select("conv_id", "turn", "command", "args")


NON_LATIN = r"(length(regexp_replace(text, '\P{L}', '', 'g')) > 0 AND (length(regexp_replace(text, '\P{L}', '', 'g')) - length(regexp_replace(text, '\P{Latin}', '', 'g'))) / length(regexp_replace(text, '\P{L}', '', 'g'))::DOUBLE > 0.5)"
INTENT_SQL = MESSAGES_SQL + rf""", tok AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM msgs), flags AS (SELECT *, list_has_any(t, ['supply','circulating']) AS supply, list_has_any(t, ['price','worth']) AS price, list_contains(t, 'listed') OR (list_contains(t, 'exchange') AND list_has_any(t, ['when','soon'])) AS listing,
 list_contains(t, 'buy') AND list_contains(t, 'token') AS buy, list_contains(t, 'holders') AS holder, regexp_matches(text, '(?i)\b(?:tell me a joke|how are you)\b') OR (len(t) <= 4 AND list_has_any(t, ['hi','hello']) AND len(list_filter(t, lambda x: x NOT IN ('hi','hello','there','all'))) = 0) AS offtopic, regexp_matches(text, '(?i)\bwhat is (?:acme|this project)\b') AS intro FROM tok)"""


@query("f3_route_intent", f"WITH {INTENT_SQL} SELECT conv_id, turn, CASE WHEN conv_id % 17 = 0 THEN 'maintenance' WHEN regexp_matches(text, '^/\\w') THEN 'command' WHEN trim(text) = '' THEN 'empty' WHEN {NON_LATIN} THEN 'non_english' WHEN offtopic THEN 'offtopic' WHEN supply THEN 'supply' WHEN price OR listing OR buy THEN 'price' WHEN holder THEN 'holder' WHEN intro THEN 'intro' ELSE 'search' END AS intent FROM flags")
def f3(spark, sf_dir):
    return M.route_intent(_messages(spark, sf_dir), RULES, maintenance=F.col("conv_id") % 17 == 0).select("conv_id", "turn", "intent")


@query("f4_is_non_latin", f"WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN translate(text, 'aehilnorstu', 'аехилнорсту') ELSE text END AS text FROM conversations) SELECT conv_id, turn, {NON_LATIN} AS other_script FROM c")
def f4(spark, sf_dir):
    text = F.when(F.col("turn") % 2 == 0, F.translate("text", "aehilnorstu", "аехилнорсту")).otherwise(F.col("text"))
    return _turns(spark, sf_dir).select("conv_id", "turn", M.is_non_latin(text).alias("other_script"))


@query("f5_token_intents", f"WITH {INTENT_SQL} SELECT conv_id, turn, supply, price, listing, buy, holder FROM flags")
def f5(spark, sf_dir):
    flags = M.token_intents(X.word_tokens("text"), RULES)
    return _messages(spark, sf_dir).select("conv_id", "turn", *[f.alias(n) for n, f in flags.items()])


@query("f6_pattern_intents", f"WITH {INTENT_SQL} SELECT conv_id, turn, offtopic, intro FROM flags")
def f6(spark, sf_dir):
    flags = M.pattern_intents(F.col("text"), X.word_tokens("text"), RULES)
    return _messages(spark, sf_dir).select("conv_id", "turn", *[f.alias(n) for n, f in flags.items()])


def _number_sql(token: str) -> str:
    bare = f"regexp_replace(regexp_replace({token}, '[,$]|%$', '', 'g'), '\\.0*$', '')"
    return f"regexp_replace(regexp_replace({bare}, '(\\.\\d*?[1-9])0+$', '\\1'), '^0+(\\d)', '\\1')"


def _numbers_sql(text: str) -> str:
    return f"unnest(list_transform(regexp_extract_all({text}, '\\d[\\d,]*\\.?\\d*'), lambda x: {_number_sql('x')}))"


@query("f7_extract_numbers", f"SELECT DISTINCT doc_id, {_numbers_sql('text')} AS number FROM documents")
def f7(spark, sf_dir):
    return M.extract_numbers(table(spark, sf_dir, "documents"))


@query("f8_unsourced_numbers", f"WITH n AS (SELECT DISTINCT conv_id, turn, role, {_numbers_sql(chr(39) + 'n ' + chr(39) + ' || (conv_id * 3 + turn % 3) || ' + chr(39) + ' of 7.50 ' + chr(39) + ' || text')} AS number FROM conversations) SELECT conv_id, turn, number FROM n a WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM n b WHERE b.conv_id = a.conv_id AND b.number = a.number AND b.turn < a.turn)")
def f8(spark, sf_dir):
    text = F.concat(F.lit("n "), F.col("conv_id") * 3 + F.col("turn") % 3, F.lit(" of 7.50 "), "text")
    turns = _turns(spark, sf_dir).select("conv_id", "turn", "role", text.alias("text"))
    return M.unsourced_numbers(turns.where("role = 'assistant'"), turns)


def _policy_sql(source: str, key: str) -> str:
    parts = []
    for family, p in M.policy_rules(RULES):
        e = p.replace("'", "''")
        if family == "figure":  # RE2 has no look-around: neighbours are matched instead
            test = r"regexp_matches(regexp_replace(' ' || text || ' ', '0\.25\s*%', '#', 'g'), '[^\d.]0\.25[^\d]')"
        else:
            test = f"regexp_matches(text, '{e}')"
        parts.append(f"SELECT {key}, '{family}' AS family, '{e}' AS pattern FROM {source} WHERE {test}")
    return " UNION ALL ".join(parts)


@query("f9_policy_violations", f"WITH {MESSAGES_SQL} {_policy_sql('msgs', 'conv_id, turn')}")
def f9(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("key", F.struct("conv_id", "turn"))
    return M.policy_violations(m, M.policy_rules(RULES), key="key").select("key.conv_id", "key.turn", "family", "pattern")


@query("f10_is_refusal", f"""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '  Sorry, I don''t ' ELSE 'The answer: i cannot ' END || text AS text FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, regexp_matches(trim(text), '(?i)^(?:{"|".join(M.REFUSALS).replace("'", "''")})') AS refusal FROM a""")
def f10(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  Sorry, I don't "), "text")).otherwise(F.concat(F.lit("The answer: i cannot "), "text"))
    return _turns(spark, sf_dir, "assistant").select("conv_id", "turn", M.is_refusal(text).alias("refusal"))


TERMS = r"array_to_string(list_transform(regexp_extract_all({}, '\S+|\s+'), lambda w: CASE WHEN contains(w, '://') OR contains(w, '@') THEN w ELSE regexp_replace(regexp_replace(w, '(?i)\bacme\b', 'Acme', 'g'), '(?i)\bac-me\b', 'Acme', 'g') END), '')"


@query("f11_normalize_terms", f"WITH {MESSAGES_SQL} SELECT conv_id, turn, {TERMS.format('text')} AS text FROM msgs")
def f11(spark, sf_dir):
    return M.normalize_terms(_messages(spark, sf_dir), ["text"], RULES)


def _answers(spark, sf_dir):
    item = lambda u: F.struct(F.lit("more").alias("label"), u.alias("url"))
    items = F.array(item(F.concat(F.lit("https://docs.example.com/"), F.col("turn"))), item(F.concat(F.lit("https://other.example.net/"), F.col("conv_id"))))
    return _messages(spark, sf_dir).withColumn("items", items)


@query("f12_filter_links", f"WITH {MESSAGES_SQL} SELECT conv_id, turn, array_to_string(list_filter(u, lambda x: starts_with(x, 'https://docs.example.com/')), ',') AS kept, array_to_string(list_filter(u, lambda x: NOT starts_with(x, 'https://docs.example.com/')), ',') AS dropped FROM (SELECT conv_id, turn, ['https://docs.example.com/' || turn, 'https://other.example.net/' || conv_id] AS u FROM msgs)")
def f12(spark, sf_dir):
    out = M.filter_links(_answers(spark, sf_dir), "items", RULES.link_prefixes)
    return out.select("conv_id", "turn", F.array_join("items.url", ",").alias("kept"), F.array_join("dropped", ",").alias("dropped"))


@query("f13_sanitize_sources", "WITH r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://api.example.com/v1/' || page_id WHEN 1 THEN 'https://docs.example.com/' || page_id ELSE url END AS s FROM pages) SELECT page_id, CASE WHEN starts_with(s, 'https://api.example.com/') THEN 'https://example.com' WHEN starts_with(s, 'https://docs.example.com/') THEN s ELSE 'https://example.com/home' END AS source FROM r")
def f13(spark, sf_dir):
    i = F.col("page_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit("https://api.example.com/v1/"), i)).when(i % 3 == 1, F.concat(F.lit("https://docs.example.com/"), i)).otherwise(F.col("url"))
    return M.sanitize_sources(table(spark, sf_dir, "pages").select("page_id", raw.alias("source")), "source", RULES)


@query("f14_enforce", f"WITH {MESSAGES_SQL}, cl AS (SELECT conv_id, turn, {TERMS.format('text')} AS text FROM msgs), v AS ({_policy_sql('cl', 'conv_id, turn')}), n AS (SELECT conv_id, turn, count(*) AS k FROM v GROUP BY ALL) SELECT conv_id, turn, CASE WHEN k > 0 THEN 'I can''t help with that.' ELSE text END AS text, coalesce(k, 0)::INT AS broken, CASE WHEN k > 0 THEN '' ELSE 'https://docs.example.com/' || turn END AS links FROM cl LEFT JOIN n USING (conv_id, turn)")
def f14(spark, sf_dir):
    out = M.enforce(_answers(spark, sf_dir), RULES)
    return out.select("conv_id", "turn", "text", F.size("violations").alias("broken"), F.array_join("items.url", ",").alias("links"))


# A response of blocks for each message: what each is to become, said outright.
GATED_SQL = f"""cl AS (SELECT conv_id, turn, {TERMS.format('text')} AS body FROM msgs), said AS (SELECT *, 'About Acme ' || turn || chr(10) || body || chr(10) || 'Acme price ' || turn || '.5' || chr(10) || 'read' || chr(10) || 'Acme elsewhere' || chr(10) || 'go' AS text FROM cl),
v AS ({_policy_sql('said', 'conv_id, turn')}), n AS (SELECT conv_id, turn, count(*) AS k FROM v GROUP BY ALL)"""


def _responses(spark, sf_dir):
    t = F.col("turn")
    item = lambda label, url: F.struct(F.lit(label).alias("label"), url.alias("url"))
    docs, other = F.concat(F.lit("https://docs.example.com/"), t), F.concat(F.lit("https://other.example.net/"), F.col("conv_id"))
    source = F.when(t % 4 == 0, F.lit("https://api.example.com/v1/price")).when(t % 4 == 2, docs).otherwise(other)
    return _messages(spark, sf_dir).select("conv_id", "turn", F.array(
        M.typed_block(type=F.lit("heading"), text=F.concat(F.lit("About ac-me "), t)), M.typed_block(type=F.lit("paragraph"), text=F.col("text")),
        M.typed_block(type=F.lit("fact"), label=F.lit("AC-ME price"), value=F.concat(t, F.lit(".5")), source=source, as_of=F.lit("2026-01-02")),
        M.typed_block(type=F.lit("links"), items=F.array(item("read", docs), item("ACME elsewhere", other))), M.typed_block(type=F.lit("buttons"), items=F.array(item("go", other))),
    ).alias("blocks"))


@query("f14_enforce_blocks", f"""WITH {MESSAGES_SQL}, {GATED_SQL} SELECT conv_id, turn, coalesce(k, 0)::INT AS broken, CASE WHEN k > 0 THEN 'warning,links' ELSE 'heading,paragraph,fact,links' END AS kinds,
CASE WHEN k > 0 THEN 'I can''t help with that.' || chr(10) || 'Acme' ELSE 'About Acme ' || turn || chr(10) || body || chr(10) || 'Acme price ' || turn || '.5' || chr(10) || 'read' END AS said,
CASE WHEN k > 0 THEN '' WHEN turn % 4 = 0 THEN 'https://example.com' WHEN turn % 4 = 2 THEN 'https://docs.example.com/' || turn ELSE 'https://example.com/home' END AS source,
CASE WHEN k > 0 THEN 'https://example.com/home' ELSE 'https://docs.example.com/' || turn END AS links, CASE WHEN k > 0 THEN '' ELSE 'https://other.example.net/' || conv_id || ',https://other.example.net/' || conv_id END AS dropped
FROM said LEFT JOIN n USING (conv_id, turn)""")
def f14_blocks(spark, sf_dir):
    out = M.enforce_blocks(_responses(spark, sf_dir), RULES)
    urls = F.flatten(F.transform(F.filter("blocks", lambda b: b["items"].isNotNull()), lambda b: b["items"]["url"]))
    return out.select("conv_id", "turn", F.size("violations").alias("broken"), F.array_join("blocks.type", ",").alias("kinds"), M.blocks_text(F.col("blocks")).alias("said"), F.array_join("blocks.source", ",").alias("source"), F.array_join(urls, ",").alias("links"), F.array_join("dropped", ",").alias("dropped"))


@query("f15_maintenance", "WITH n AS (SELECT '' AS message FROM region WHERE r_regionkey = 0) SELECT conv_id, turn, coalesce(nullif(message, ''), CASE WHEN message IS NOT NULL THEN 'Back soon.' END) AS notice FROM conversations LEFT JOIN n ON true WHERE role = 'user'")
def f15(spark, sf_dir):
    control = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("").alias("message"))
    return M.apply_maintenance(_turns(spark, sf_dir, "user").select("conv_id", "turn"), control, "Back soon.")


def _blocks(spark, sf_dir):
    d = F.col("turn")
    null = F.lit(None).cast("string")
    none = F.lit(None).cast("array<struct<label:string,url:string>>")

    def block(kind, text=null, label=null, value=null, source=null, as_of=null, items=none):
        return F.struct(F.lit(kind).alias("type"), text.alias("text"), label.alias("label"), value.alias("value"), source.alias("source"), as_of.alias("as_of"), items.alias("items"))

    links = F.array(F.struct(F.lit("a.b").alias("label"), F.concat(F.lit("https://e.com/(x)"), d).alias("url")))
    return _turns(spark, sf_dir, "assistant").select("conv_id", "turn", F.array(
        block("heading", F.concat(F.lit("Turn #"), d)), block("paragraph", F.concat(F.lit("a **b.c** and `x*y` [l-1](https://e.com/) *i* "), "text")),
        block("fact", label=F.lit("Price"), value=F.concat(d, F.lit(".5")), source=F.lit("https://e.com"), as_of=F.lit("2026-01-02")), block("links", items=links), block("buttons"),
    ).alias("blocks"))


ESC = r"regexp_replace({}, '([_*\[\]()~`>#+\-=|{{}}.!\\])', '\\\1', 'g')"
RENDER_SQL = f"""rend AS (SELECT conv_id, turn, ['*' || {ESC.format("'Turn #' || turn")} || '*', 'a *b\\.c* and `x*y` [l\\-1](https://e.com/) _i_ ' || {ESC.format('text')},
 '*Price*' || chr(10) || turn || '\\.5' || chr(10) || 'Source: [https://e\\.com](https://e.com)' || chr(10) || 'As of 2026\\-01\\-02', '[a\\.b](https://e.com/(x\\)' || turn || ')'] AS t FROM conversations WHERE role = 'assistant')"""


@query("f16_render_blocks", f"WITH {RENDER_SQL} SELECT conv_id, turn, array_to_string(t, chr(10) || '~' || chr(10)) AS rendered FROM rend")
def f16(spark, sf_dir):
    return M.render_blocks(_blocks(spark, sf_dir)).select("conv_id", "turn", F.array_join("rendered", "\n~\n").alias("rendered"))


@query("f17_pack_messages", f"""WITH RECURSIVE {RENDER_SQL}, b AS (SELECT conv_id, turn, unnest(t) AS text, generate_subscripts(t, 1) AS i FROM rend),
r AS (SELECT conv_id, turn, i, text AS cur, 1 AS part FROM b WHERE i = 1 UNION ALL SELECT b.conv_id, b.turn, b.i, CASE WHEN length(r.cur) + 2 + length(b.text) > 200 AND r.cur <> '' THEN b.text WHEN r.cur = '' THEN b.text ELSE r.cur || chr(10) || chr(10) || b.text END, CASE WHEN length(r.cur) + 2 + length(b.text) > 200 AND r.cur <> '' THEN r.part + 1 ELSE r.part END FROM r JOIN b ON b.conv_id = r.conv_id AND b.turn = r.turn AND b.i = r.i + 1)
SELECT conv_id, turn, part, arg_max(cur, i) AS text FROM r GROUP BY ALL""")
def f17(spark, sf_dir):
    packed = M.pack_messages(M.render_blocks(_blocks(spark, sf_dir)), limit=200)
    return packed.select("conv_id", "turn", F.posexplode_outer("parts").alias("part", "text")).withColumn("part", F.col("part") + 1)


@query("f18_chat_context", "WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM t WHERE role = 'user') SELECT conv_id AS user_id, string_agg('User: ' || text || chr(10) || 'Bot: ' || coalesce(answer, ''), chr(10) ORDER BY r) AS context FROM n WHERE r <= 3 GROUP BY 1")
def f18(spark, sf_dir):
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = _turns(spark, sf_dir).withColumn("response", F.coalesce(after, F.lit(""))).where("role = 'user'")
    return M.chat_context(turns.select(F.col("conv_id").alias("user_id"), F.col("turn").alias("seq"), F.col("text").alias("message"), "response"))


TOPICS = {"supply": ("supply", "circulating"), "market": ("exchange", "listed", "buy"), "people": ("holders",)}
RELATED = {"supply": ("market",), "market": ("people",)}


@query("f19_match_topics", f"""WITH {MESSAGES_SQL}, p AS (SELECT conv_id * 100 + turn AS query_id, unnest(list_filter([CASE WHEN contains(lower(text), 'supply') OR contains(lower(text), 'circulating') THEN 'supply' END, CASE WHEN contains(lower(text), 'exchange') OR contains(lower(text), 'listed') OR contains(lower(text), 'buy') THEN 'market' END, CASE WHEN contains(lower(text), 'holders') THEN 'people' END], lambda x: x IS NOT NULL)) AS topic FROM msgs),
a AS (SELECT query_id, topic, true AS pr FROM p UNION ALL SELECT query_id, CASE topic WHEN 'supply' THEN 'market' ELSE 'people' END, false FROM p WHERE topic <> 'people') SELECT query_id, topic, max(pr) AS primary, r_name AS content FROM a JOIN region ON r_regionkey = CASE topic WHEN 'supply' THEN 0 WHEN 'market' THEN 1 ELSE 2 END GROUP BY query_id, topic, r_name""")
def f19(spark, sf_dir):
    topic = F.when(F.col("r_regionkey") == 0, "supply").when(F.col("r_regionkey") == 1, "market").when(F.col("r_regionkey") == 2, "people")
    sections = table(spark, sf_dir, "region").select(topic.alias("topic"), F.col("r_name").alias("content")).where("topic is not null")
    m = _messages(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    return M.match_topics(m, TOPICS, sections, RELATED)


@query("f20_repeated_within", """WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS age FROM events)
SELECT user_id, event_type, event_id, coalesce(age < 86400000000, false) AS hit FROM e""")
def f20(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("seq"))
    return M.repeated_within(e, 86400, ("user_id", "event_type")).select("user_id", "event_type", F.col("seq").alias("event_id"), "hit")


@query("f21_broadcasts", f"WITH {MESSAGES_SQL}, v AS (SELECT DISTINCT conv_id, turn FROM ({_policy_sql('msgs', 'conv_id, turn')})), a AS (SELECT *, conv_id * 100 + turn AS request_id, CASE WHEN turn % 4 = 0 THEN NULL ELSE 'c' || turn % 3 END AS channel FROM msgs ANTI JOIN v USING (conv_id, turn)) SELECT substr(sha256(request_id || '|' || text), 1, 32) AS broadcast_id, 'c' || n_regionkey AS channel, n_name AS chat FROM a JOIN nation ON channel IS NULL OR channel = 'c' || n_regionkey")
def f21(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("request_id", F.col("conv_id") * 100 + F.col("turn"))
    m = m.withColumn("channel", F.when(F.col("turn") % 4 != 0, F.concat(F.lit("c"), F.col("turn") % 3))).withColumn("chat", F.lit(None).cast("string"))
    chats = table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), "n_regionkey").alias("channel"), F.col("n_name").alias("chat"))
    return M.fan_out(M.admit_broadcasts(m, M.policy_rules(RULES)), chats)


@query("f22_answer_quality", "SELECT conv_id, turn, (contains(lower(text), 'tion') :: INT + contains(lower(text), 'und') :: INT + contains(lower(text), 'que') :: INT) AS n_terms, contains(lower(text), 'ing') AND contains(lower(text), 'eau') AS contradicts, length(text) >= 100 AND (contains(lower(text), 'tion') :: INT + contains(lower(text), 'und') :: INT + contains(lower(text), 'que') :: INT) >= 2 AND NOT (contains(lower(text), 'ing') AND contains(lower(text), 'eau')) AS good FROM conversations WHERE role = 'assistant'")
def f22(spark, sf_dir):
    return M.answer_quality(_turns(spark, sf_dir, "assistant"), ["tion", "und", "que"], [("ing", "eau")]).select("conv_id", "turn", "n_terms", "contradicts", "good")
