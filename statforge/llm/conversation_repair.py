"""Operator 11: cheapest repair of a conversation's structure by a fold in Spark SQL.

Turns stand in order of conversation, turn (nulls first), role and text after one range
shuffle, which splits a conversation of any size over tasks; the row's place in that order
is its id. A window marks repeated turns. Turns then shrink to (id, role class, fault) and are
folded in blocks of at most 2 ** ``BLOCK_BITS`` by ``aggregate``, which carries four (cost, audit)
structs, one for each state of the grammar ``(system? (user assistant)+)?``, through ``least``.
A block that may continue a conversation is folded from every state, so that blocks compose:
a second fold over the blocks of each conversation picks the cheapest repair. Only those
letters, never texts, meet in one row; texts are joined to the edits by id afterwards.

Audits are compared while they grow. That is safe: of two audits over the same turns one is
never the beginning of the other at equal cost, as what follows could only be inserts. Within
the fold ``R`` and ``I`` make an assistant, ``S`` and ``J`` a user; a state allows one of the
two, so the order of audits is that of the plain letters.

Nulls: a null role or text is one space, so the text is blank and the role no known one; null
turns come first and don't count as gaps; a null conv_id is a conversation. Repeated rows:
all but the first are duplicates. Ties in turn fall to the smaller role, then text. Roles
are judged by their first letter; a kept turn keeps its role string. Very long texts are
hashed in their task and joined by id. A conversation without turns gets zeros and an empty
repair; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Costs of the edits; fixed values of the task.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 40
STATES = ["open", "system", "user", "assistant"]
LEGAL = ["su", "ua", "au"]
#: Turns of one conversation that are folded at once, as a power of two.
BLOCK_BITS = 12


def state(cost: int, audit: str = "") -> Column:
    return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(audit).alias("audit"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def after(before: Column, cost, letter) -> Column:
    """A state with one more edit."""
    letter = letter if isinstance(letter, Column) else F.lit(letter)
    return F.struct((before["cost"] + cost).alias("cost"), F.concat(before["audit"], letter).alias("audit"))


def four(open_: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(open_.alias("open"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def with_inserts(acc: Column) -> Column:
    """The four states once any turns are inserted."""
    before_user = lambda a: F.least(a["open"], a["system"], a["assistant"])
    made = lambda a: F.least(a["user"], let(before_user(a), lambda b: after(b, INSERT, "J")))
    return let(acc, lambda a: let(made(a), lambda user: four(a["open"], a["system"], user, F.least(a["assistant"], after(user, INSERT, "I")))))


def edited(acc: Column, turn: Column) -> Column:
    """The four states after one more turn (``role``: s, u, a or x; ``pay``: what it costs to
    leave it) and inserts behind it."""
    role, pay = turn["role"], turn["pay"]
    own = lambda r, other: F.when(role == r, "K").otherwise(other)
    more = lambda r: pay + F.when(role == r, 0).otherwise(REROLE)
    kept = lambda: after(acc["open"], pay + F.when(role == "s", 0).otherwise(NEVER), "K")
    step = four(
        after(acc["open"], DELETE, "D"),
        F.least(after(acc["system"], DELETE, "D"), kept()),
        F.least(after(acc["user"], DELETE, "D"), let(F.least(acc["open"], acc["system"], acc["assistant"]), lambda b: after(b, more("u"), own("u", "S")))),
        F.least(after(acc["assistant"], DELETE, "D"), after(acc["user"], more("a"), own("a", "R"))),
    )
    return with_inserts(step)


def start() -> Column:
    return with_inserts(entered("open"))


def entered(at: str) -> Column:
    return F.struct(*[state(0 if s == at else NEVER).alias(s) for s in STATES])


def joined(acc: Column, block: Column) -> Column:
    """The four states after a further block, whose ``ends`` 1 to 4 start from each state."""
    ends = [F.get(block["ends"], F.lit(i + 1)) for i in range(4)]
    both = lambda s, end, t: F.struct((acc[s]["cost"] + end[t]["cost"]).alias("cost"), F.concat(acc[s]["audit"], end[t]["audit"]).alias("audit"))
    return four(*[F.least(*[both(s, end, t) for s, end in zip(STATES, ends, strict=True)]) for t in STATES])


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text in order with ``id``, ``gone`` (the row only stands for its
    conversation), role class, fault flags; written to the shared folder, as ids must last."""
    gone = F.col("gone").cast("boolean") if "gone" in turns.columns else F.lit(False)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), gone.alias("gone"))
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    own = own.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id())
    first = F.substring("role", 1, 1)
    ending = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     ")), -1, 1)
    own = own.withColumns({"initial": F.when(first.isin("s", "u", "a"), first).otherwise("x"), "is_blank": ending == "", "is_cut": ~ending.isin(".", "!", "?"), "digest": F.sha2("text", 256)})
    return staged(own, "conversation-turns")


def flagged(turns: DataFrame) -> DataFrame:
    """id, conversation, turn, role class and first fault of each row, without its text."""
    seen = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("id")) > 1
    small = turns.select("id", "conv_id", "turn", "initial", "gone", "is_blank", "is_cut", seen.alias("is_seen"))
    fault = F.when(F.col("is_blank"), "blank").when(F.col("is_seen"), "duplicate").when(F.col("is_cut"), "truncated")
    return small.select("id", "conv_id", "turn", "initial", "gone", F.when(~F.col("gone"), fault).alias("fault"))


def block_folds(turns: DataFrame, bits: int) -> DataFrame:
    """One row for each block of a conversation: its folds, roles, ids and counts."""
    here = ~F.col("gone")
    pay = F.when(F.col("fault").isin("blank", "duplicate"), NEVER).when(F.col("fault") == "truncated", TRUNCATED).otherwise(0).cast("long")
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    blocks = turns.groupBy("conv_id", F.shiftright("id", bits).alias("block")).agg(
        F.sort_array(F.collect_list(F.when(here, F.struct("id", F.col("initial").alias("role"), pay.alias("pay"))))).alias("rows"),
        F.min("id").alias("first_id"),
        F.min(F.when(here, F.col("turn"))).alias("min_turn"),
        F.max(F.when(here, F.col("turn"))).alias("max_turn"),
        F.size(F.collect_set(F.when(here, F.col("turn")))).alias("n_turns"),
        *[count(n) for n in ("blank", "duplicate", "truncated")],
    )
    # behind another conversation's row in the same block there is no earlier block
    alone = F.col("first_id").bitwiseAND(F.lit((1 << bits) - 1)) != 0
    starts = F.when(alone, F.array(start())).otherwise(F.array(start(), *[entered(s) for s in STATES]))
    folds = F.transform(starts, lambda s: F.aggregate("rows", s, edited))
    return blocks.select("conv_id", "block", folds.alias("ends"), F.array_join(F.transform("rows", lambda r: r["role"]), "").alias("roles"), F.transform("rows", lambda r: r["id"]).alias("ids"), "min_turn", "max_turn", "n_turns", "blank", "duplicate", "truncated")


def repairs(turns: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of each
    conversation of ``ordered_turns``, with the ids of its turns and ``steps``: for each turn the
    inserts before it and its edit, then trailing inserts, in the letters of the fold."""
    names = ["block", "ends", "roles", "ids", "min_turn", "max_turn", "n_turns"]
    convs = block_folds(flagged(turns), bits).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("blocks"), *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")])
    of = lambda name: F.transform("blocks", lambda b: b[name])
    folded = F.aggregate(F.slice("blocks", F.lit(2), F.size("blocks")), F.get(F.get("blocks", F.lit(0))["ends"], F.lit(0)), joined)
    convs = convs.withColumns({"folded": folded, "roles": F.array_join(of("roles"), ""), "ids": F.flatten(of("ids")), "spans": F.filter("blocks", lambda b: b["max_turn"].isNotNull())})
    convs = convs.withColumn("best", F.least(F.col("folded.open"), F.col("folded.assistant")))
    shared = F.size(F.filter("spans", lambda b, i: F.coalesce(b["min_turn"] == F.get("spans", i - 1)["max_turn"], F.lit(False))))
    distinct = F.aggregate("spans", F.lit(0).cast("long"), lambda n, b: n + b["n_turns"]) - shared
    gaps = F.array_max(F.transform("spans", lambda b: b["max_turn"])) - F.array_min(F.transform("spans", lambda b: b["min_turn"])) + 1 - distinct
    legal = F.regexp_count("roles", F.lit(f"(?={'|'.join(LEGAL)})"))
    illegal = F.greatest(F.length("roles") - 1, F.lit(0)) - legal
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    audit = F.col("best.audit")
    return convs.select(
        "conv_id",
        long(gaps).alias("gaps"),
        *[long(F.col(n)).alias(n) for n in ("blank", "duplicate", "truncated")],
        long(illegal).alias("illegal"),
        F.col("best.cost").alias("cost"),
        F.translate(audit, "SJ", "RI").alias("audit"),
        "ids",
        F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]|[IJ]+$"), F.lit(0)).alias("steps"),
    )


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, place and part (their order), edit, turn
    (null if inserted), role and text. Each edit meets its turn by id, so a long conversation
    is spread over tasks."""
    steps = found.select("conv_id", "ids", F.posexplode("steps").alias("place", "step"))
    trailing = -1 - F.get("ids", F.size("ids") - 1)  # an id of its own that no turn has
    steps = steps.select("conv_id", "place", "step", F.coalesce(F.get("ids", F.col("place")), trailing).alias("id"))
    rows = steps.join(turns.filter(~F.col("gone")).select("id", "turn", "role", "text"), "id", "left")
    own = F.right("step", F.lit(1))
    made = lambda x: F.when(x.isin("S", "J"), "user").otherwise("assistant")
    part = lambda edit, turn, role, text: F.struct(edit.alias("edit"), turn.alias("turn"), role.alias("role"), text.alias("text"))
    inserted = F.transform(F.filter(F.split(F.translate("step", "DKRS", ""), ""), lambda x: x != ""), lambda x: part(F.lit("I"), F.lit(None).cast("long"), made(x), F.lit("")))
    kept = part(F.translate(own, "S", "R"), F.col("turn"), F.when(own == "K", F.col("role")).otherwise(made(own)), F.col("text"))
    parts = F.when(own.isin("K", "R", "S"), F.concat(inserted, F.array(kept))).otherwise(inserted)
    return rows.select("conv_id", "place", F.posexplode(parts).alias("part", "x")).select("conv_id", "place", "part", "x.*")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults by crc32 of ``conv_id:turn`` modulo 20; dropped ones are ``gone``."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = ordered_turns(damaged(table(spark, sf_dir, "conversations")))
    found = staged(repairs(turns), "conversation-repairs")
    lines = repaired_turns(turns, found).select("conv_id", "place", "part", F.concat_ws(":", "role", "text").alias("line"))
    texts = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "part", "line"))).alias("lines"))
    hashes = texts.select(F.col("conv_id").alias("own"), F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("sha"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return found.join(hashes, F.col("conv_id").eqNullSafe(F.col("own")), "left").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha", empty).alias("repaired_sha256"))


def _best(*choices: str) -> str:
    return f"list_sort([{', '.join(choices)}])[1]"


def _after(before: str, cost: str, letter: str, line: str | None = None) -> str:
    """SQL of a state {c, a, t} with one more edit; ``line``: what the repair gets."""
    text = f"{before}.t" if line is None else f"{before}.t || CASE WHEN {before}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"{{'c': {before}.c + {cost}, 'a': {before}.a || '{letter}', 't': {text}}}"


def _inserts(source: str) -> str:
    user = _best("u", *[_after(s, "5", "I", "'user:'") for s in ("o", "s", "a")])
    return f"""SELECT conv_id, i, o, s, u, {_best("a", _after("u", "5", "I", "'assistant:'"))} AS a FROM (SELECT conv_id, i, o, s, {user} AS u, a FROM ({source}))"""


_COST = "CASE fault WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE 1000000000 END"
_OWN = "text"
_NEVER = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}"
_STEP = f"""SELECT f.conv_id, f.i, {_after("o", "2", "D")} AS o,
{_best(_after("s", "2", "D"), _after("o", f"{_COST} + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END", "K", f"role || ':' || {_OWN}"))} AS s,
{_best(_after("u", "2", "D"), *[x for p in ("o", "s", "a") for x in (_after(p, f"{_COST} + CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END", "K", f"role || ':' || {_OWN}"), _after(p, f"{_COST} + 1", "R", f"'user:' || {_OWN}"))])} AS u,
{_best(_after("a", "2", "D"), _after("u", f"{_COST} + CASE WHEN initial = 'a' THEN 0 ELSE 1000000000 END", "K", f"role || ':' || {_OWN}"), _after("u", f"{_COST} + 1", "R", f"'assistant:' || {_OWN}"))} AS a
FROM walk w JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1"""

OP11_SQL = f"""WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS (SELECT raw.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM raw, crc),
turns AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(2) c(n) WHERE code <> 0 AND (n = 0 OR code = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial FROM turns),
marked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS following FROM numbered),
flagged AS (SELECT *, CASE WHEN b THEN 'blank' WHEN seen THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS name,
  CASE WHEN b OR seen THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 1 ELSE 0 END AS fault
  FROM (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS b FROM marked)),
convs AS (SELECT DISTINCT conv_id FROM conversations),
walk(conv_id, i, o, s, u, a) AS ({_inserts(f"SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS o, {_NEVER} AS s, {_NEVER} AS u, {_NEVER} AS a FROM convs")}
  UNION ALL {_inserts(_STEP)}),
best AS (SELECT conv_id, {_best("arg_max(o, i)", "arg_max(a, i)")} AS b FROM walk GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(name = 'blank') AS blank, count_if(name = 'duplicate') AS duplicate, count_if(name = 'truncated') AS truncated,
  count_if(following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal FROM flagged GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, b.b.c AS cost, b.b.a AS audit, sha256(b.b.t) AS repaired_sha256
FROM best b LEFT JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""
