"""Repair of conversations whose turns were lost, emptied, cut, doubled or given to the wrong role, at least cost.

Roles have to follow the grammar ``(s?(ua)+)?`` over their initials. Edits are Keep (0), Rerole to user or assistant (2),
Delete (3; required for blank and duplicate turns) and Insert an empty user or assistant turn (2); a truncated turn that is
not deleted adds 1. Of the cheapest repairs the one whose edits' initials are ASCII-least stands.

Turns are numbered by one range sort and cut into segments of ``SPAN``. A recursive DuckDB query inside hash-partitioned
batches advances one turn of all segments at a time and keeps, per state of the grammar, the least cost and audit. A segment
that does not begin its conversation is walked from every state; longer conversations then walk over their segments'
results, ``SPAN`` at a time, until one is left. So no task holds more than segments, whatever the length of a conversation.
Inserts count with the edit of the turn they stand before, so no audit at a turn is a prefix of another one there, and the
lesser of two stays the lesser whatever follows: keeping one per state loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, numbered, stage

#: Turns of a segment, and segments walked together.
SPAN_BITS = 6
SPACE = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; what each role leads to from each.
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: The only state a user or assistant turn can lead to.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
#: Edits that end a conversation in each state: its cost and audit.
TAILS = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
INITIALS = "sua"
CLEAN, TRUNCATED, DUPLICATE, BLANK = range(4)
MOVES = "array<struct<start: int, state: int, cost: long, audit: string, path: string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def edits() -> list[tuple[int, int, int, int, str]]:
    """(kind, from, to, cost, audit) of one turn with the inserts before it, the best for each; kind is initial * 4 + fault.

    More than two inserts before a turn come back to a state that fewer reach.
    """
    best: dict[tuple[int, int, int], tuple[int, str]] = {}
    for initial in range(len(INITIALS) + 1):
        for fault in range(4):
            for start in range(4):
                state = start
                for inserts in range(3):
                    after = [("D", 3, state)]
                    if fault in (CLEAN, TRUNCATED):
                        after.append(("R", 2 + fault, NEXT[state]))
                        kept = STEP.get((INITIALS[initial : initial + 1], state))
                        after += [("K", fault, kept)] if kept is not None else []
                    for letter, cost, to in after:
                        key, found = (initial * 4 + fault, start, to), (2 * inserts + cost, "I" * inserts + letter)
                        best[key] = min(best.get(key, found), found)
                    state = NEXT[state]
    return [(*key, *found) for key, found in best.items()]


WALK = """
WITH RECURSIVE walk AS (
  SELECT unit, 0 AS place, s.start, s.start AS state, 0::BIGINT AS cost, '' AS audit, '' AS path
  FROM units JOIN (VALUES (0), (1), (2), (3)) s(start) ON s.start = 0 OR NOT leads
  UNION ALL
  SELECT unit, place + 1, start, state, best.cost, best.audit, best.path FROM (
    SELECT w.unit, w.place, w.start, e.state, min({'cost': w.cost + e.cost, 'audit': w.audit || e.audit, 'path': w.path || e.state}) AS best
    FROM walk w JOIN steps e ON e.unit = w.unit AND e.place = w.place AND e.start = w.state GROUP BY w.unit, w.place, w.start, e.state))
SELECT unit, list({'start': start, 'state': state, 'cost': cost, 'audit': audit, 'path': path} ORDER BY start, state) AS moves
FROM walk JOIN units USING (unit) WHERE place = size GROUP BY unit ORDER BY unit
"""
COUNTING = """
SELECT unit, count(*) FILTER (place >= 0 AND fault = 3) AS blank, count(*) FILTER (place >= 0 AND fault = 2) AS duplicate,
  count(*) FILTER (place >= 0 AND fault = 1) AS truncated,
  count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal,
  count(*) FILTER (place >= 0 AND turn IS NOT NULL AND turn IS DISTINCT FROM before) AS turns
FROM (SELECT *, lag(initial) OVER w AS earlier, lag(turn) OVER w AS before FROM rows WINDOW w AS (PARTITION BY unit ORDER BY place))
GROUP BY unit ORDER BY unit
"""


def _duck():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
    con.execute("CREATE TABLE edits (kind INT, start INT, state INT, cost BIGINT, audit VARCHAR)")
    con.executemany("INSERT INTO edits VALUES (?, ?, ?, ?, ?)", edits())
    return con


def _flat(lists: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Numbers of the lists and their elements, list by list."""
    return lists.value_parent_indices(), lists.flatten()


def _moves(con, units: pa.Table) -> pa.Array:
    con.register("units", units)
    found = con.sql(WALK).to_arrow_table().column("moves").combine_chunks()
    con.unregister("units")
    return found


def _walk_turns(segments: DataFrame) -> DataFrame:
    """tree, segment, nodes, the counts and ``moves`` of each segment of turns (tree, segment, nodes, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for batch in batches:
            unit, rows = _flat(batch.column("rows"))
            fields = {name: rows.field(name) for name in ("place", "turn", "initial", "fault")}
            con.register("arrived", pa.table({"unit": unit, **fields}))
            con.execute("CREATE OR REPLACE TABLE rows AS SELECT * FROM arrived")
            con.execute(
                "CREATE OR REPLACE TABLE steps AS SELECT unit, place, e.start, e.state, e.cost, e.audit FROM rows JOIN edits e"
                " ON e.kind = fault + 4 * CASE initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END WHERE place >= 0"
            )
            con.execute("CREATE OR REPLACE TABLE sized AS SELECT unit, max(place) + 1 AS size FROM rows GROUP BY unit")
            leads = pa.table({"unit": pa.array(range(batch.num_rows)), "leads": [s == 0 for s in batch.column("segment").to_pylist()]})
            con.register("firsts", leads)
            units = con.sql("SELECT unit, size, leads FROM sized JOIN firsts USING (unit)").to_arrow_table()
            counts = con.sql(COUNTING).to_arrow_table().combine_chunks()
            moves = _moves(con, units)
            columns = [batch.column("tree"), batch.column("segment"), batch.column("nodes"), *(counts.column(c).combine_chunks() for c in COUNTS), moves]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "segment", "nodes", *COUNTS, "moves"])

    schema = "tree string, segment long, nodes long, " + ", ".join(f"{c} long" for c in COUNTS) + f", moves {MOVES}"
    return map_arrow(segments, run, schema)


def _walk_segments(groups: DataFrame) -> DataFrame:
    """tree, segment, nodes, moves of each group of segments (tree, segment, nodes, parts: a list of moves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        for batch in batches:
            part_unit, parts = _flat(batch.column("parts"))
            entry_part, entries = _flat(parts)
            part_unit = part_unit.to_pylist()
            first: dict[int, int] = {}
            for k, u in enumerate(part_unit):
                first.setdefault(u, k)
            owner = [part_unit[p] for p in entry_part.to_pylist()]
            place = [p - first[u] for p, u in zip(entry_part.to_pylist(), owner, strict=True)]
            names = ("start", "state", "cost", "audit")
            con.register("arrived", pa.table({"unit": owner, "place": place, **{n: entries.field(n) for n in names}}))
            con.execute("CREATE OR REPLACE TABLE steps AS SELECT * FROM arrived")
            sizes = [len(p) for p in batch.column("parts")]
            leads = [s == 0 for s in batch.column("segment").to_pylist()]
            moves = _moves(con, pa.table({"unit": list(range(batch.num_rows)), "size": sizes, "leads": leads}))
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("segment"), batch.column("nodes"), moves], names=["tree", "segment", "nodes", "moves"])

    return map_arrow(groups, run, f"tree string, segment long, nodes long, moves {MOVES}")


def _tree(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _turns(turns: DataFrame) -> DataFrame:
    """tree, turn, role, text of every turn; null roles and texts are one space."""
    blank = F.lit(" ")
    return turns.select(_tree(F.col("conv_id")).alias("tree"), "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))


def _faults(rows: DataFrame) -> DataFrame:
    """tree, pos, nodes, turn, initial, fault; the first of equal turns is found by a minimum and met again by its place."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    first = rows.groupBy("tree", said.alias("said")).agg(F.min("pos").alias("pos")).select("tree", "pos", F.lit(True).alias("first"))
    ended = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(ended == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.right(ended, F.lit(1)).isin(".", "!", "?"), CLEAN).otherwise(TRUNCATED)
    )
    small = rows.select("tree", "pos", "nodes", "turn", F.substring("role", 1, 1).alias("initial"), F.when(ended == "", "").otherwise(F.right(ended, F.lit(1))).alias("text"))
    return small.join(first, ["tree", "pos"], "left").select("tree", "pos", "nodes", "turn", "initial", fault.cast("int").alias("fault"))


def _segments(faults: DataFrame) -> DataFrame:
    """Segments of turns in order; each begins with a copy (place -1) of the turn before it, for what neighbours tell."""
    span = 1 << SPAN_BITS
    home = F.struct(F.shiftright("pos", SPAN_BITS).alias("segment"), (F.col("pos") % span).cast("int").alias("place"))
    ahead = F.struct((F.shiftright("pos", SPAN_BITS) + 1).alias("segment"), F.lit(-1).alias("place"))
    last = (F.col("pos") % span == span - 1) & (F.col("pos") + 1 < F.col("nodes"))
    placed = faults.withColumn("home", F.explode(F.when(last, F.array(home, ahead)).otherwise(F.array(home))))
    row = F.struct("home.place", "turn", "initial", "fault")
    return placed.groupBy("tree", F.col("home.segment").alias("segment")).agg(F.first("nodes").alias("nodes"), F.sort_array(F.collect_list(row)).alias("rows"))


def _picked(moves: Column, start: Column, state: Column) -> Column:
    return F.filter(moves, lambda m: (m["start"] == start) & (m["state"] == state))[0]


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was found and decided per conversation, and the repaired turns.

    ``turns``: conv_id, turn, role, text; other columns are not read. The first result has tree, gaps, blank, duplicate,
    truncated, illegal, cost, audit for every conversation with turns; the second tree, pos, sub, role, text, edit for each
    turn that is there in the end, in the order of pos and sub (inserted ones come before what they precede). ``tree`` is
    "=" and the conv_id, or empty for null.

    Turns stand by ``turn``, nulls first; those of one turn by role and text, so a result does not depend on how the table
    lies, and repeated rows stand together. A null role or text is one space; a role other than system, user, assistant
    goes by its first letter, and one that is empty can not be kept. A turn is blank without anything but ASCII white space,
    a duplicate if role and text came before in its conversation, truncated if its last character but white space is not
    ``.``, ``!`` or ``?``; the first of these counts. An empty table gives no rows.
    """
    rows = numbered(_turns(turns), ["turn", "role", "text"])
    faults = _faults(rows)
    base = stage(_walk_turns(_segments(faults)), "repair-segments")
    levels, level, span = [base], base, 1 << SPAN_BITS
    long = span
    while level.filter(F.col("nodes") > long).limit(1).count():
        # Only conversations of several segments go on; a group is one segment of the next level.
        parts = F.sort_array(F.collect_list(F.struct("segment", "moves"))).getField("moves").alias("parts")
        inner = level.filter(F.col("nodes") > long).select("tree", "segment", "nodes", "moves")
        grouped = inner.groupBy("tree", F.shiftright("segment", SPAN_BITS).alias("segment")).agg(F.first("nodes").alias("nodes"), parts)
        level = stage(_walk_segments(grouped), "repair-groups")
        levels.append(level)
        long *= span
    tops = None
    for depth, level in enumerate(levels):
        # A conversation ends at the first level where one segment holds it.
        low, high = span**depth, span ** (depth + 1)
        done = level.filter((F.col("nodes") <= high) & ((F.col("nodes") > low) | F.lit(depth == 0)))
        tail_cost = F.element_at(F.array(*[F.lit(TAILS[s][0]) for s in range(4)]), F.col("m.state") + 1)
        ends = F.transform("moves", lambda m: F.struct((m["cost"] + _tail(m["state"], 0)).alias("cost"), F.concat(m["audit"], _tail(m["state"], 1)).alias("audit"), m["state"].alias("state")))
        best = done.select("tree", "nodes", F.lit(depth).alias("depth"), F.array_min(ends).alias("best")).select("tree", "nodes", "depth", "best.*")
        tops = best if tops is None else tops.unionByName(best)
    tops = stage(tops, "repair-tops")
    chosen = None
    for depth in reversed(range(len(levels))):
        own = tops.filter(F.col("depth") == depth).select("tree", F.lit(0).cast("long").alias("segment"), F.lit(0).alias("start"), "state")
        chosen = own if chosen is None else own.unionByName(chosen)
        move = levels[depth].select("tree", "segment", "moves").join(chosen, ["tree", "segment"])
        move = move.select("tree", "segment", "start", _picked(F.col("moves"), F.col("start"), F.col("state")).alias("move"))
        if depth:
            path = F.posexplode(F.regexp_extract_all("move.path", F.lit("[0-3]"), F.lit(0))).alias("k", "to")
            split = move.select("tree", "segment", "start", "move.path", path)
            before = F.when(F.col("k") == 0, F.col("start")).otherwise(F.expr("substring(path, k, 1)").cast("int"))
            chosen = stage(split.select("tree", (F.shiftleft("segment", SPAN_BITS) + F.col("k")).alias("segment"), before.alias("start"), F.col("to").cast("int").alias("state")), "repair-chosen")
    letters = F.posexplode(F.regexp_extract_all("move.audit", F.lit("I*[KRD]"), F.lit(0))).alias("k", "edit")
    edited = move.select("tree", "segment", "start", "move.path", letters)
    before = F.when(F.col("k") == 0, F.col("start")).otherwise(F.expr("substring(path, k, 1)").cast("int"))
    edited = edited.select("tree", (F.shiftleft("segment", SPAN_BITS) + F.col("k")).alias("pos"), before.alias("state"), "edit")
    tails = tops.filter(F.col("state").isin(1, 2)).select("tree", F.col("nodes").alias("pos"), "state", _tail(F.col("state"), 1).alias("edit"))
    joined = edited.join(rows.select("tree", "pos", "role", "text"), ["tree", "pos"])
    joined = joined.unionByName(tails.withColumn("role", F.lit(None).cast("string")).withColumn("text", F.lit(None).cast("string")))
    counts = base.groupBy("tree").agg(*[F.sum(c).alias(c) for c in COUNTS])
    spans = rows.groupBy("tree").agg(F.max("turn").alias("high"), F.min("turn").alias("low"))
    report = tops.select("tree", "cost", "audit").join(counts, "tree").join(spans, "tree")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    return report.select("tree", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit"), _lines(joined)


def _tail(state: Column, part: int) -> Column:
    """Cost (0) or audit (1) of what ends a conversation in ``state``."""
    return F.element_at(F.array(*[F.lit(TAILS[s][part]) for s in range(4)]), state + 1)


def _lines(edited: DataFrame) -> DataFrame:
    """The turns that each edit leaves: inserted ones in the roles the grammar wants, then the turn itself."""
    one = F.when(F.col("state") == 2, "assistant").otherwise("user")
    two = F.when(F.col("state") == 2, "user").otherwise("assistant")
    inserts = F.length(F.regexp_replace("edit", "[^I]", ""))
    letter = F.regexp_extract("edit", "[KRD]", 0)
    inserted = [F.struct(F.lit(k).alias("sub"), role.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")) for k, role in enumerate((one, two))]
    own_role = F.when(letter == "K", F.col("role")).otherwise(F.when(inserts == 1, two).otherwise(one))
    own = F.struct(F.lit(2).alias("sub"), own_role.alias("role"), F.col("text"), letter.alias("edit"))
    kept = F.when(letter.isin("K", "R"), F.array(own)).otherwise(F.array().cast("array<struct<sub: int, role: string, text: string, edit: string>>"))
    lines = F.concat(F.slice(F.array(*inserted), F.lit(1), inserts), kept)
    return edited.select("tree", "pos", F.inline(lines))


def digests(lines: DataFrame) -> DataFrame:
    """tree and the SHA-256 of its lines ``role:text``, joined by newlines in order, fed line by line: a conversation of any
    length takes no more memory than a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, state = None, None
        schema = pa.schema([("tree", pa.string()), ("repaired_sha256", pa.string())])
        for batch in batches:
            done = []
            for of, line in zip(batch.column("tree").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if state is not None and of == tree:
                    state.update(b"\n")
                else:
                    if state is not None:
                        done.append((tree, state.hexdigest()))
                    tree, state = of, hashlib.sha256()
                state.update(line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in range(2)], schema=schema)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([state.hexdigest()])], schema=schema)

    lined = lines.select("tree", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lined.repartition("tree").sortWithinPartitions("tree", "pos", "sub").select("tree", "line")
    return map_arrow(ordered, run, "tree string, repaired_sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with known faults, by the CRC of ``conv_id:turn`` modulo 20: 0 drops a row, 1
    empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 gives it to the user. Nulls (of ids in the key, of
    roles and texts) are one space; conv_id and turn themselves stay null."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = (F.crc32(key.cast("binary")) % 20).alias("kind")
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    marked = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind).filter("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        copies.alias("copy"),
    ).drop("copy")


def repaired(turns: DataFrame) -> DataFrame:
    """One row per conv_id of ``turns`` (null is one): what ``repair`` finds once ``damage`` was done, and the digest of the
    repaired conversation. Conversations that lost all turns have zeros, an empty audit and the digest of nothing."""
    report, lines = repair(damage(turns))
    nothing = hashlib.sha256(b"").hexdigest()
    every = turns.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", _tree(F.col("conv_id")).alias("tree"))
    out = every.join(report, "tree", "left").join(digests(lines), "tree", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text
  FROM src JOIN (VALUES (0), (1)) c(copy) ON copy = 0 OR kind = 3 WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS ini,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM damaged),
rows AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM placed),
chain(src, mid, paid, letters, lines) AS (VALUES
  ('e', 'e', 0, '', ''), ('e', 'u', 2, 'I', E'user:\n'), ('e', 'a', 4, 'II', E'user:\nassistant:\n'),
  ('s', 's', 0, '', ''), ('s', 'u', 2, 'I', E'user:\n'), ('s', 'a', 4, 'II', E'user:\nassistant:\n'),
  ('u', 'u', 0, '', ''), ('u', 'a', 2, 'I', E'assistant:\n'),
  ('a', 'a', 0, '', ''), ('a', 'u', 2, 'I', E'user:\n')),
follow(mid, next) AS (VALUES ('e', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u'), ('e', 's')),
ops(op, price) AS (VALUES ('K', 0), ('R', 2), ('D', 3)),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 'e' AS st, {'cost': 0::BIGINT, 'audit': '', 'lines': ''} AS best FROM rows
  UNION ALL
  SELECT conv_id, i, st, min(best) FROM (
    SELECT r.conv_id, r.i, CASE op WHEN 'D' THEN c.mid ELSE f.next END AS st,
      {'cost': (best.cost + paid + price + CASE WHEN fault = 't' AND op <> 'D' THEN 1 ELSE 0 END)::BIGINT, 'audit': best.audit || letters || op,
       'lines': best.lines || c.lines || CASE op WHEN 'K' THEN r.role || ':' || r.text || E'\n' WHEN 'D' THEN ''
          WHEN 'R' THEN CASE f.next WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text || E'\n' END} AS best
    FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN chain c ON c.src = w.st
      JOIN ops ON op = 'D' OR fault NOT IN ('b', 'd') JOIN follow f ON f.mid = c.mid AND (op = 'K' AND f.next = r.ini OR op <> 'K' AND f.next <> 's')
  ) GROUP BY conv_id, i, st),
ended AS (
  SELECT conv_id, min({'cost': (best.cost + paid)::BIGINT, 'audit': best.audit || letters, 'lines': best.lines || c.lines}) AS best
  FROM walk w JOIN chain c ON c.src = w.st AND (c.mid = 'a' OR c.mid = 'e')
  WHERE i = (SELECT max(i) FROM rows r WHERE r.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY conv_id),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.lines, length(best.lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
