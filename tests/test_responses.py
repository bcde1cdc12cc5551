"""Responses of typed blocks: packing against a fold, the gate as one."""

import random

from pyspark.sql import functions as F

from groundwork.operators import messages as M

KIND = f"id int, blocks array<{M.BLOCK}>"


def block(kind, text=None, label=None, value=None, source=None, items=None):
    return (kind, text, label, value, source, None, items)


def folded(texts, limit):
    """Parts as a plain loop joins them."""
    parts, current = [], ""
    for t in filter(None, texts):
        longer = f"{current}\n\n{t}" if current else t
        if current and len(longer) > limit:
            parts.append(current)
            current = t
        else:
            current = longer
    return [*parts, current]


def test_packing_equals_a_fold(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice(("é😀x", "a", "b.", "")) * rng.randrange(9) for _ in range(rng.randrange(14))]) for i in range(400)] + [(400, ["z" * 50] * 5), (401, [])]
    d = spark.createDataFrame([*rows, (402, None)], "id int, rendered array<string>")
    got = {r.id: r.parts for r in M.pack_messages(d, limit=20).collect()}
    assert got == {i: folded(t, 20) for i, t in rows} | {402: [""]}


def test_gate_over_whole_responses(spark):
    rules = M.Rules(brand="Acme", brand_patterns=(r"(?i)\bac-me\b",), link_prefixes=("https://docs.e/",), api_hosts={"https://api.e/": "https://e"}, site="https://e/home", banned_terms=("pre-?sales?",))
    ok, bad = ("AC-ME docs", "https://docs.e/a"), ("else", "https://x.e/b")
    rows = [
        (1, [block("heading", "AC-ME"), block("fact", label="ac-me", value="ac-me 7", source="https://api.e/v1"), block("fact", label="l", value="v", source="internal://x"), block("links", items=[bad, ok]), block("buttons", items=[bad])]),
        (2, [block("paragraph", "fine"), block("links", items=[("the presale", "https://docs.e/a")])]),
        (3, [block("fact", label="buy", value="now", source="https://docs.e/s")]),
        (4, [block("paragraph", "see [ac-me](https://x.e/ac-me)"), block("links", items=[]), block("buttons"), None]),
        (5, []), (6, None), (7, [block("paragraph"), block("fact", source=None)]),
    ]
    got = {r.id: r for r in M.enforce_blocks(spark.createDataFrame(rows, KIND), rules).collect()}
    shown = lambda i: [(b.type, b.text or b.label, b.source, [tuple(x) for x in b["items"] or []]) for b in got[i].blocks]
    assert shown(1) == [("heading", "Acme", None, []), ("fact", "Acme", "https://e", []), ("fact", "l", "https://e/home", []), ("links", None, None, [("Acme docs", "https://docs.e/a")])]
    assert got[1].blocks[1].value == "Acme 7" and got[1].dropped == ["https://x.e/b"] * 2
    refusal = [("warning", rules.refusal, None, []), ("links", None, None, [("Acme", "https://e/home")])]
    assert shown(2) == shown(3) == refusal and {v.family for v in got[2].violations} == {"term"} and {v.family for v in got[3].violations} == {"solicitation"}
    assert shown(4) == [("paragraph", "see [Acme](https://x.e/ac-me)", None, [])] and shown(5) == shown(6) == []
    assert [b.type for b in got[7].blocks] == ["paragraph", "fact"] and got[7].blocks[1].source == "https://e/home"


def test_gate_twice_is_gate_once_and_renders(spark):
    rules = M.Rules(brand="Acme", brand_patterns=(r"(?i)\bac-me\b",), link_prefixes=("https://docs.e/",), site="https://docs.e/home")
    rng = random.Random(6)
    some = [block("paragraph", "ac-me *x*"), block("links", items=[("a", "https://docs.e/a"), ("b", "https://no/b")]), block("buttons", items=[("c", "https://no/c")]), block("heading", "buy now"), block("fact", "", "l", "v", "https://no")]
    d = spark.createDataFrame([(i, [rng.choice(some) for _ in range(rng.randrange(5))]) for i in range(60)], KIND)
    once = M.enforce_blocks(d, rules)
    again = M.enforce_blocks(once.select("id", "blocks"), rules)
    assert sorted(once.select("id", "blocks").collect()) == sorted(again.select("id", "blocks").collect())
    sent = M.pack_messages(M.render_blocks(once)).select(F.explode("messages").alias("m")).collect()
    assert all("no/" not in r.m.text and "ac\\-me" not in r.m.text and not r.m.buttons for r in sent)
