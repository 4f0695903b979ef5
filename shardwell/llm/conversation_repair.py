"""Conversation structure repair: the cheapest edits that give role initials (s?(ua)+)?, by a rank-compressed program.

A row of a conversation is one macro edit: a run of inserted turns, then Delete, Keep or Rerole of the row. Written as
initials (D, IK, IIR, ...) the macros form a prefix-free code, so audits of equally many rows compare as sequences of
codes do, and a code's place in ASCII order stands for it. A layer of the program holds, for each state of the pattern
(nothing yet, after s, u, a), the least cost and the rank of its audit among the audits of the layer; the next layer
compares (cost, rank, code) and ranks anew. No audit string is kept: parent pointers give it afterwards, and with it
the repaired turns.

Layers compose: a stretch of rows is summed up by the cheapest way from each state to each, with ranks over all sixteen,
and stretches chain like rows. So rows are dealt by ranges of (conversation, turn, ...) and streamed in order: a
conversation inside one range is settled there; one that is cut, or longer than PIECE rows, becomes pieces of at most
PIECE rows, whose summaries alone meet (one row a piece), and each piece is then reconstructed by itself. No task holds
more than a piece, whatever one conversation has; report() adds a conversation's audit, which is one value.

Faults, the first that holds: blank, duplicate (role and text seen earlier in the conversation), truncated. The first
turn of texts that occur twice is found by an aggregate over digests; equal rows of one turn are neighbours in the order.

Defined results: turns are ordered by (turn, role, text), nulls first; null role and null text are one space; a role
that is empty has no initial and can't be kept; rows of a null conv_id form one conversation; repeated rows are
duplicates; ties of cost go to the ASCII-least audit, which fixes the turns too; a conversation all of whose rows are lost
has zeros, an empty audit and no turns; columns of other names are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups

#: Rows of a piece at most.
PIECE = 4096
BLANKS = " \t\n\x0b\x0c\r"
# Costs of the edits, of keeping a truncated row, and of an inserted turn; at most two insertions help.
COSTS = {"D": 2, "K": 0, "R": 1}
TRUNCATED, INSERT = 5, 5
MACROS = ["I" * k + edit for k in range(3) for edit in "DKR"]
CODES = sorted(MACROS)

# States of the pattern: 0 nothing, 1 after s, 2 after u, 3 after a. NEXT: after one more user or assistant turn.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ENDS = {0: "", 1: "II", 2: "I", 3: ""}
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
STATES = tuple(NEXT)
Options = dict[int, list[tuple[int, int, int]]]


def _options(initial: str, fault: str) -> Options:
    """From each state: (next state, cost, code) of the best macro to it, for a row of this initial ("" any other)."""
    out: Options = {}
    for s in STATES:
        best: dict[int, tuple[int, int]] = {}
        for code, macro in enumerate(CODES):
            at, edit = s, macro[-1]
            for _ in macro[:-1]:
                at = NEXT[at]
            if edit != "D":
                if fault == "gone":
                    continue
                at = NEXT[at] if edit == "R" else KEEPS.get(initial, {}).get(at)
                if at is None:
                    continue
            found = (INSERT * (len(macro) - 1) + COSTS[edit] + TRUNCATED * (edit != "D" and fault == "cut"), code)
            best[at] = min(best.get(at, found), found)
        out[s] = [(to, cost, code) for to, (cost, code) in best.items()]
    return out


OPTIONS = {(i, f): _options(i, f) for i in ("s", "u", "a", "") for f in ("", "cut", "gone")}
Cells = dict[tuple[int, int], tuple[int, int]]


def advance(cells: Cells, options: Options) -> tuple[Cells, dict[tuple[int, int], tuple[int, int]]]:
    """The next layer, and from where each of its cells came: (state before, code). A cell is (start, state): (cost, rank)."""
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for (start, s), (cost, rank) in cells.items():
        for to, more, code in options[s]:
            found = (cost + more, rank, code, s)
            if (start, to) not in best or found < best[start, to]:
                best[start, to] = found
    order = {x: i for i, x in enumerate(sorted({b[1:3] for b in best.values()}))}
    return {k: (b[0], order[b[1:3]]) for k, b in best.items()}, {k: (b[3], b[2]) for k, b in best.items()}


def layers(kinds: list[tuple[str, str]], starts: tuple[int, ...]) -> tuple[Cells, list[dict]]:
    cells: Cells = {(s, s): (0, 0) for s in starts}
    parents = []
    for kind in kinds:
        cells, came = advance(cells, OPTIONS[kind])
        parents.append(came)
    return cells, parents


def best_end(cells: Cells) -> tuple[int, int]:
    """(cost, last state) of the cheapest audit from the start of a conversation, with the insertions that end it."""
    return min((cost + INSERT * len(ENDS[s]), rank, ENDS[s], s) for (start, s), (cost, rank) in cells.items() if start == 0)[::3]


def path(parents: list[dict], start: int, end: int) -> list[int]:
    """The codes from one state to another, by the parent pointers."""
    codes, at = [], end
    for came in reversed(parents):
        at, code = came[start, at]
        codes.append(code)
    return codes[::-1]


def replay(codes: list[int], rows: list[dict], start: int, tail: str) -> tuple[str, list[dict]]:
    """Audit and repaired turns of a stretch."""
    at, turns = start, []

    def turn(text: str) -> None:
        nonlocal at
        at = NEXT[at]
        turns.append({"role": "assistant" if at == 3 else "user", "text": text})

    for code, row in zip(codes, rows, strict=True):
        for edit in CODES[code]:
            if edit == "I":
                turn("")
            elif edit == "R":
                turn(row["text"])
            elif edit == "K":
                at = KEEPS[row["role"][:1]][at]
                turns.append({"role": row["role"], "text": row["text"]})
    for _ in tail:
        turn("")
    return "".join(CODES[c] for c in codes) + tail, turns


def _kind(row: dict) -> tuple[str, str]:
    return row["role"][:1] if row["role"][:1] in KEEPS else "", {"": "", "truncated": "cut"}.get(row["fault"], "gone")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SEAM = "head string, tail string, low long, high long, distinct long, cells array<long>"
TURNS = "array<struct<role: string, text: string>>"
PIECES = f"conv_id long, part long, whole boolean, {', '.join(f'{c} long' for c in COUNTS)}, audit string, turns {TURNS}, rows array<struct<role: string, text: string, fault: string>>, seam struct<{SEAM}>"
LEGAL = {"su", "ua", "au"}


def _sum(rows: list[dict]) -> dict:
    """Counts and seam of a stretch of rows."""
    out = {c: sum(r["fault"] == c for r in rows) for c in ("blank", "duplicate", "truncated")}
    initials = [r["role"][:1] for r in rows]
    out["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    out["seam"] = {"head": initials[0] if rows else None, "tail": initials[-1] if rows else None, "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "distinct": len(set(turns))}
    return out


def _joined(parts: list[dict]) -> dict:
    """Counts of a conversation from those of its stretches, in order."""
    out = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
    full = [p["seam"] for p in parts if p["seam"]["head"] is not None]
    out["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(full, full[1:]))
    turned = [s for s in full if s["low"] is not None]
    distinct = sum(s["distinct"] for s in turned) - sum(a["high"] == b["low"] for a, b in zip(turned, turned[1:]))
    return out | {"gaps": turned[-1]["high"] - turned[0]["low"] + 1 - distinct if turned else 0}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _pieces(schema: pa.Schema, piece: int):
    """Streams rows in order: whole conversations are settled, others leave pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        conv, held, cut, last, begun = None, [], True, None, False

        def flush(cut: bool) -> dict:
            nonlocal part
            part += 1
            summed, kinds = _sum(held), [_kind(r) for r in held]
            out = {"conv_id": conv, "part": part, "whole": not cut} | summed
            if cut:
                cells, _ = layers(kinds, STATES)
                out["seam"]["cells"] = [x for (start, s), (cost, rank) in cells.items() for x in (start, s, cost, rank)]
                return out | {"rows": held}
            cells, parents = layers(kinds, (0,))
            cost, end = best_end(cells)
            audit, turns = replay(path(parents, 0, end), held, 0, ENDS[end])
            return out | _joined([summed]) | {"cost": cost, "audit": audit, "turns": turns, "seam": None}

        for batch in batches:
            ready = []
            for row in batch.to_pylist():
                if begun and row["conv_id"] != conv:
                    ready.append(flush(cut))
                    held, cut, last = [], False, None
                elif len(held) >= piece:
                    ready.append(flush(True))
                    held, cut = [], True
                begun, conv = True, row["conv_id"]
                if row["lost"]:
                    continue
                key = row["turn"], row["role"], row["text"]
                if row["fault"] != "blank" and (row["again"] or key == last):
                    row["fault"] = "duplicate"
                last = key
                held.append(row)
            if ready:
                yield _batch(ready, schema)
        if begun:
            yield _batch([flush(True)], schema)  # it may go on in the next range

    return run


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv_id"] != held[0]["conv_id"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


WAY = f"conv_id long, part long, start int, end int, tail string, {', '.join(f'{c} long' for c in COUNTS)}"


def _chain(schema: pa.Schema):
    """Summaries of the pieces of a conversation, in order: where each piece starts and ends. Counts stand at the last piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _by_conversation(batches):
            cells: Cells = {(0, 0): (0, 0)}
            parents = []
            for p in parts:
                flat, options = p["seam"]["cells"], {s: [] for s in STATES}
                for start, s, cost, rank in zip(*[iter(flat)] * 4, strict=True):
                    options[start].append((s, cost, rank))
                cells, came = advance(cells, options)
                parents.append(came)
            cost, at = best_end(cells)
            out, tail = [], ENDS[at]
            for p, came in zip(reversed(parts), reversed(parents), strict=True):
                before = came[0, at][0]
                out.append({"conv_id": p["conv_id"], "part": p["part"], "start": before, "end": at, "tail": tail})
                at, tail = before, ""
            out[0] |= _joined(parts) | {"cost": cost}
            yield _batch(out, schema)

    return run


def _rebuild(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                _, parents = layers([_kind(r) for r in p["rows"]], (p["start"],))
                p["audit"], p["turns"] = replay(path(parents, p["start"], p["end"]), p["rows"], p["start"], p["tail"])
                out.append({k: p.get(k) for k in schema.names})
            yield _batch(out, schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _key(*parts: Column) -> Column:
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]).cast("binary"), 256)


OUT = f"conv_id long, part long, single boolean, {', '.join(f'{c} long' for c in COUNTS)}, audit string, turns {TURNS}"


def repair(rows: DataFrame, lost_col: str | None = None, piece: int = PIECE) -> DataFrame:
    """Repaired conversations in pieces, ordered by part: audit and turns of the piece, and single (it is the only one).
    Counts and cost of the conversation stand at its last piece.

    rows: conv_id, turn, role, text. lost_col: a boolean column; its rows are no turns, but their conversations are reported.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    gone = F.coalesce(F.col(lost_col), F.lit(False)) if lost_col else F.lit(False)
    blank = F.lit(" ")
    data = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), gone.alias("lost"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(trimmed == "", "blank").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    data = data.withColumn("fault", fault).withColumn("key", _key(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "role", "text"))
    twice = data.filter("not lost and fault <> 'blank'").groupBy("key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    salt = F.xxhash64("turn", "key").cast("string")
    data = join_groups(data, twice, "key", "n", salt, data.count())
    data = data.withColumn("again", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False))).drop("first", "n", "key")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    ranges = data.repartitionByRange(*order, F.left("role", F.lit(8)).asc(), F.left("text", F.lit(32)).asc())  # equal rows stay together
    pieces = scratch.write(ranges.sortWithinPartitions(*order, "role", "text").mapInArrow(_pieces(_arrow(PIECES), piece), PIECES), "pieces")

    cut = pieces.filter("not whole")
    ways = cut.select("conv_id", "part", "blank", "duplicate", "truncated", "illegal", "seam").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    ways = ways.mapInArrow(_chain(_arrow(WAY)), WAY).drop("conv_id")
    rebuilt = cut.select("conv_id", "part", "rows").join(ways, "part").withColumn("single", F.lit(False))
    rebuilt = rebuilt.mapInArrow(_rebuild(_arrow(OUT)), OUT)
    return pieces.filter("whole").withColumn("single", F.lit(True)).select(*rebuilt.columns).unionByName(rebuilt)


def turns(repaired: DataFrame) -> DataFrame:
    """A row a repaired turn; (part, place) is its order in the conversation."""
    return repaired.select("conv_id", "part", F.posexplode("turns").alias("place", "turn")).select("conv_id", "part", "place", "turn.role", "turn.text")


REPORT = f"conv_id long, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"


def _fold(schema: pa.Schema):
    """Pieces in order: the digest takes in one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, begun = None, None, False

        def close() -> pa.RecordBatch:
            return _batch([{"conv_id": conv, **state["counts"], "audit": "".join(state["audit"]), "repaired_sha256": state["hash"].hexdigest()}], schema)

        for batch in batches:
            for p in batch.to_pylist():
                if not begun or p["conv_id"] != conv:
                    if begun:
                        yield close()
                    state, conv, begun = {"hash": hashlib.sha256(), "audit": [], "first": True, "counts": {}}, p["conv_id"], True
                for t in p["turns"]:
                    state["hash"].update(("" if state["first"] else "\n").encode() + f"{t['role']}:{t['text']}".encode())
                    state["first"] = False
                state["audit"].append(p["audit"])
                state["counts"] = {c: p[c] for c in COUNTS}
        if begun:
            yield close()

    return run


def report(repaired: DataFrame) -> DataFrame:
    """A row a conversation: faults, cost, audit, and the digest of its repaired role:text lines."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    alone = repaired.filter("single").select("conv_id", *COUNTS, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    folded = repaired.filter("not single").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_fold(_arrow(REPORT)), REPORT)
    return alone.unionByName(folded)


def damage(rows: DataFrame) -> DataFrame:
    """The contract's faults, by the checksum of conv_id:turn; dropped rows stay as lost."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    data = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("_fault"))
    said = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    data = data.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), (F.col("_fault") == 0).alias("lost"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_copy"))
    return data.drop("_copy")
