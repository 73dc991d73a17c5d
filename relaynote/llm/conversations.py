"""Repair of conversations whose turns lack, repeat, break off or have wrong roles, by a fold over sorted turns.

Window functions mark each turn's first fault. Sorted turns are then folded by aggregate(): its accumulator holds four
(cost, audit) structs, the cheapest edits that bring the roles so far to the start, past a system turn, past a user's or
past an assistant's, and least() takes the cheapest of the edits that lead to each. An audit has a letter for each edit:
Keep, Rerole, Delete, Insert. Audits of equal cost that lead to the same place never begin with one another, so the
ASCII-least of them stays the least whatever follows.

Turns of a conversation are gathered in blocks of BLOCK turn numbers. The fold of a block from each of the four places
is a table of 16 structs, and tables of successive blocks are put together as the fold itself is, so audits are not
copied once for each turn of a long conversation, and texts meet in one row only to make the repaired text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

#: Turn numbers whose turns are gathered and folded together. Turns without a number are one block.
BLOCK = 512
#: Cost of what cannot be.
NEVER = 1 << 40
PLACES = ("start", "system", "user", "assistant")
_BLANK = r"[\x20\x09-\x0D]"
_STATE = "struct<cost:bigint,audit:string>"
_FOLD = f"struct<{','.join(f'{p}:{_STATE}' for p in PLACES)}>"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with faults planted by crc32(`conv_id:turn`) % 20 (nulls: one space).

    0 drops the turn, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes its role user.
    """
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), written("role").alias("role"), written("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = rows.filter("kind <> 0").withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("time", F.explode(times)).select("conv_id", "turn", "role", "text")


def _initial(role: Column) -> Column:
    """The role's initial, '-' for all but s, u and a."""
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("-")


def _illegal(before: Column, after: Column) -> Column:
    """1 where the initials of two neighbours are none of su, ua, au."""
    return F.when(before.isNotNull() & ~F.concat(before, after).isin("su", "ua", "au"), 1).otherwise(0)


def turn_blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each `block` turn numbers of a conversation: conv_id, block, its sorted turns (role, text), and their codes.

    A code is the initial and the first fault among this block's turns: b blank, d duplicate, t truncated, `.` none.
    Turns of one number are in the order of role and text.
    """
    null = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), null("role").alias("role"), null("text").alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 63)).cast("long")))
    order = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    same = Window.partitionBy("conv_id", "block", "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(~F.col("text").rlike(f"[^{_BLANK[1:]}"), "b")
        .when(F.row_number().over(same) > 1, "d")
        .when(~F.col("text").rlike(rf"[.!?]{_BLANK}*\z"), "t")
        .otherwise(".")
    )
    rows = rows.withColumn("fault", fault).withColumn("initial", _initial(F.col("role")))
    rows = rows.withColumns({"at": F.row_number().over(order), "before": F.lag("initial").over(order), "turn_before": F.lag("turn").over(order)})
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    gathered = rows.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "text", F.concat("initial", "fault").alias("code")))).alias("turns"),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(new_turn.cast("long")).alias("n_turns"),
        F.sum(_illegal(F.col("before"), F.col("initial"))).alias("illegal"),
    )
    texts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return gathered.select("conv_id", "block", texts.alias("turns"), F.col("turns.code").alias("codes"), "first_turn", "last_turn", "n_turns", "illegal")


def repeated_from_earlier_blocks(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, again: places from 0) of turns whose role and text an earlier block of the conversation holds."""
    spans = blocks.groupBy("conv_id").agg(F.min("block").alias("least"), F.max("block").alias("most")).filter("least < most")
    spans = spans.withColumnRenamed("conv_id", "of")
    turns = blocks.join(spans, blocks["conv_id"].eqNullSafe(spans["of"])).select("conv_id", "block", F.posexplode("turns").alias("place", "turn"))
    turns = turns.select("conv_id", "block", "place", "turn.role", "turn.text")
    first = turns.groupBy("conv_id", "role", "text").agg(F.min("block").alias("least"), F.max("block").alias("most")).filter("least < most")
    first = first.withColumnsRenamed({c: f"_{c}" for c in ("conv_id", "role", "text")})
    again = turns.join(first, turns["conv_id"].eqNullSafe(first["_conv_id"]) & (turns["role"] == first["_role"]) & (turns["text"] == first["_text"]))
    return again.filter("block > least").groupBy("conv_id", "block").agg(F.collect_list("place").alias("again"))


def _state(cost: Column | int, audit: Column | str) -> Column:
    cost = F.lit(cost) if isinstance(cost, int) else cost
    audit = F.lit(audit) if isinstance(audit, str) else audit
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit")).cast(_STATE)


def _edited(state: Column, cost: Column | int, letter: Column | str) -> Column:
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return _state(state["cost"] + cost, F.concat(state["audit"], letter))


def _fold_of(**states: Column) -> Column:
    return F.struct(*[states[p].alias(p) for p in PLACES]).cast(_FOLD)


def _only(place: str) -> Column:
    """The fold of no turns from a place: it is reached at no cost, the others never."""
    return _fold_of(**{p: _state(0 if p == place else NEVER, "") for p in PLACES})


def _with_inserts(fold: Column) -> Column:
    """The fold after turns that are inserted, a user's, an assistant's or both."""
    start, system, user, assistant = (fold[p] for p in PLACES)
    user_too = F.least(user, *[_edited(x, 2, "I") for x in (start, system, assistant)])
    assistant_too = F.least(assistant, _edited(user, 2, "I"), *[_edited(x, 4, "II") for x in (start, system)])
    return _fold_of(start=start, system=system, user=user_too, assistant=assistant_too)


def _with_turn(fold: Column, code: Column) -> Column:
    """The fold after one more turn, kept, reroled or deleted; a blank or duplicate turn can only be deleted."""
    initial, fault = F.substring(code, 1, 1), F.substring(code, 2, 1)
    stays = F.when(fault.isin("b", "d"), NEVER).when(fault == "t", 1).otherwise(0)
    start, system, user, assistant = (fold[p] for p in PLACES)
    as_is = lambda letter: initial == letter
    change = lambda letter: stays + F.when(as_is(letter), 0).otherwise(2)
    named = lambda letter: F.when(as_is(letter), "K").otherwise("R")
    return _fold_of(
        start=_edited(start, 3, "D"),
        system=F.least(_edited(system, 3, "D"), _edited(start, stays + F.when(as_is("s"), 0).otherwise(NEVER), "K")),
        user=F.least(_edited(user, 3, "D"), *[_edited(x, change("u"), named("u")) for x in (start, system, assistant)]),
        assistant=F.least(_edited(assistant, 3, "D"), _edited(user, change("a"), named("a"))),
    )


def fold_block(codes: Column, fold: Column) -> Column:
    """The fold after a block of codes. Inserts and the turn are folded one after the other, so neither is computed twice."""
    steps = F.flatten(F.transform(codes, lambda c: F.array(F.lit(""), c)))
    return F.aggregate(steps, fold, lambda acc, c: F.when(c == "", _with_inserts(acc)).otherwise(_with_turn(acc, c)))


def fold_blocks(blocks: Column) -> Column:
    """The cheapest (cost, audit) of a conversation, from its blocks of codes in order."""
    none = _fold_of(**{p: _state(NEVER, "") for p in PLACES})

    def joined(fold: Column, codes: Column) -> Column:
        paths = F.array(*[F.struct(fold[p].alias("to"), fold_block(codes, _only(p)).alias("on")) for p in PLACES])
        add = lambda path, p: _edited(path["to"], path["on"][p]["cost"], path["on"][p]["audit"])
        return F.aggregate(paths, none, lambda acc, path: _fold_of(**{p: F.least(acc[p], add(path, p)) for p in PLACES}))

    first = fold_block(F.element_at(blocks, 1), _only("start"))
    rest = F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))
    return F.aggregate(rest, first, joined, lambda acc: F.least(acc["start"], _with_inserts(acc)["assistant"]))


def _role(at: Column, system: Column) -> Column:
    """The role of the turn at a place (from 0) of a repaired conversation, after its system turn, if it has one."""
    return F.when((at - system) % 2 == 0, "user").otherwise("assistant")


def repaired_lines(turns: Column, edits: Column, at: Column, system: Column) -> Column:
    """`role:text` of each turn that the edits leave or insert. edits: for each turn the letters up to its own, then the rest."""
    start = F.struct(at.cast("int").alias("at"), F.array().cast("array<string>").alias("lines"))

    def edit(acc: Column, pair: Column) -> Column:
        turn, letters, at = pair["turns"], pair["edits"], acc["at"]
        own = F.regexp_replace(letters, "I", "")
        n = F.length(letters) - F.length(own)
        inserted = F.slice(F.array(*[F.concat(_role(at + k, system), F.lit(":")) for k in (0, 1)]), 1, n)
        role = F.when(own == "K", turn["role"]).otherwise(_role(at + n, system))
        line = F.when(own.isin("K", "R"), F.array(F.concat(role, F.lit(":"), turn["text"]))).otherwise(F.array().cast("array<string>"))
        new = F.concat(inserted, line)
        return F.struct((at + F.size(new)).cast("int").alias("at"), F.concat(acc["lines"], new).alias("lines"))

    return F.aggregate(F.arrays_zip(turns.alias("turns"), edits.alias("edits")), start, edit, lambda acc: acc["lines"])


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text): counts of faults, cost and audit, and the repaired text.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired (`role:text` in lines).
    Null roles and texts are one space. Turns are in the order of turn (nulls first), role and text; of turns equal in
    role and text the first is no duplicate. A null conv_id is a conversation like any other. Roles of other initials
    than s, u and a, the empty one too, can only be reroled or deleted. Long conversations are folded in blocks; very
    long texts are carried along. An empty table gives an empty result. Other columns are ignored.
    """
    blocks = save(turn_blocks(turns, block), "turns")
    light = blocks.drop("turns")
    again = repeated_from_earlier_blocks(blocks).withColumnsRenamed({"conv_id": "_conv_id", "block": "_block"})
    light = light.join(again, light["conv_id"].eqNullSafe(again["_conv_id"]) & (light["block"] == again["_block"]), "left").drop("_conv_id", "_block")
    marked = F.transform("codes", lambda c, i: F.when(F.array_contains("again", i) & ~c.endswith("b"), F.concat(F.substring(c, 1, 1), F.lit("d"))).otherwise(c))
    light = light.withColumn("codes", F.when(F.col("again").isNull(), F.col("codes")).otherwise(marked))

    parts = F.sort_array(F.collect_list(F.struct("block", "codes", "illegal")))
    convs = light.groupBy("conv_id").agg(parts.alias("parts"), F.min("first_turn").alias("low"), F.max("last_turn").alias("high"), F.sum("n_turns").alias("n_turns"))
    convs = convs.withColumn("best", fold_blocks(F.col("parts.codes")))
    with_fault = lambda f: F.size(F.filter(F.flatten("parts.codes"), lambda c: c.endswith(f))).cast("long")
    joints = F.zip_with(
        "parts", F.slice("parts", 2, 1 << 30),
        lambda a, b: F.when(b.isNull(), 0).otherwise(_illegal(F.substring(F.element_at(a["codes"], -1), 1, 1), F.substring(F.element_at(b["codes"], 1), 1, 1))),
    )
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)
    convs = save(
        convs.select(
            "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps"),
            with_fault("b").alias("blank"), with_fault("d").alias("duplicate"), with_fault("t").alias("truncated"),
            (total(F.col("parts.illegal")) + total(joints)).alias("illegal"), F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"),
            F.transform("parts", lambda p: F.struct(p["block"].alias("block"), F.size(p["codes"]).alias("n"))).alias("parts"),
        ),
        "repairs",
    )

    # each block's edits, the place at which it begins and whether a system turn comes first: an even number of turns else
    edits = convs.select("conv_id", "parts", "audit", F.expr("regexp_extract_all(audit, 'I*[KRD]|I+$', 0)").alias("edits"))
    edits = edits.select("conv_id", "parts", "audit", "edits", F.posexplode("parts").alias("k", "part"))
    first = F.aggregate(F.slice("parts", 1, F.col("k")), F.lit(0), lambda acc, p: acc + p["n"])
    edits = edits.withColumn("first", first)
    last = (F.col("k") == F.size("parts") - 1).cast("int")
    left = lambda letters: F.length(F.regexp_replace(letters, "D", ""))
    edits = edits.select(
        F.col("conv_id").alias("_conv_id"), F.col("part.block").alias("_block"), F.slice("edits", F.col("first") + 1, F.col("part.n") + last).alias("edits"),
        left(F.array_join(F.slice("edits", 1, F.col("first")), "")).alias("at"), (left(F.col("audit")) % 2).alias("system"),
    )
    both = blocks.select("conv_id", "block", "turns").join(edits, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("block") == F.col("_block")))
    lines = both.select("conv_id", "block", repaired_lines(F.col("turns"), F.col("edits"), F.col("at"), F.col("system")).alias("lines")).filter(F.size("lines") > 0)
    # the repaired text is one value, so its blocks meet in one row
    texts = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", F.array_join("lines", "\n").alias("text")))).alias("texts"))
    texts = texts.select(F.col("conv_id").alias("_conv_id"), F.array_join("texts.text", "\n").alias("repaired"))
    out = convs.drop("parts").join(texts, convs["conv_id"].eqNullSafe(texts["_conv_id"]), "left").drop("_conv_id")
    return out.withColumn("repaired", F.coalesce("repaired", F.lit("")))
