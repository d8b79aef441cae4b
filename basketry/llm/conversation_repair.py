"""Repair of the turn structure of conversations by a suffix-shared automaton.

A conversation is read as its signature: one symbol per row for the role's initial and its fault. The cheapest edits of
a signature from some row on depend on nothing but the rest of the signature and the state of the grammar, so signatures
are merged from the end: the automaton has one node per distinct rest, whichever conversations it ends. Distinct
signatures are range-partitioned and sorted by their reverse; a task walks its part of the automaton depth first, and
computes cost and first edit once per node and grammar state. Texts meet their edits again in one ordered stream.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.llm.exchange import written

#: What counts as white space, and what a finished text ends with.
SPACE, STOPS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Costs of the edits; a row left in although its text is cut off adds CUT.
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: Characters after which a conversation is continued in a further segment.
SEGMENT_CHARS = 1 << 20

# Grammar (s?(ua)+)?: states 0 at the start, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
_AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The state after the one role that may be inserted or set here, and that role.
_TURN = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
#: A conversation that ends in a state is completed by insertions.
_END_COST, _END_EDIT = (0, 2 * INSERT, INSERT, 0), b".II."

_turn = pa.struct([("role", pa.string()), ("text", pa.string())])
_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_segment = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int32()), ("symbols", pa.string()), ("turns", pa.list_(_turn))]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high")]
)
_repaired = pa.schema(
    [("conv_id", pa.int64()), ("segment", pa.int32()), ("edits", pa.string()), ("turns", pa.list_(_turn))]
    + [(c, pa.int64()) for c in _FACTS]
)
_SEGMENTS = (
    "conv_id bigint, segment int, symbols string, turns array<struct<role:string,text:string>>, blank bigint,"
    " duplicate bigint, truncated bigint, illegal bigint, distinct bigint, low bigint, high bigint"
)
REPAIRED = (
    "conv_id bigint, segment int, edits string, turns array<struct<role:string,text:string>>, "
    + ", ".join(f"{c} bigint" for c in _FACTS)
)


def damaged(turns: DataFrame) -> DataFrame:
    """Faults by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it,
    4 sets the role user. Null role or text, and null ids within the checksum, read as one space; extra columns go."""
    rows = turns.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))))
    named = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(named.cast("binary")) % 20
    rows = rows.withColumn("fault", fault).where("fault != 0").fillna(" ", ["role", "text"])
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    rows.clear()
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered rows to segments with their symbols and counts; holds one segment."""
    out: list[tuple] = []
    conv, started, segment, last_turn, last_initial = None, False, 0, None, None
    symbols: list[str] = []
    turns: list[dict] = []
    size = blank = duplicate = truncated = illegal = distinct = 0
    low = high = None

    def close() -> None:
        nonlocal symbols, turns, size, blank, duplicate, truncated, illegal, distinct, low, high
        out.append((conv, segment, "".join(symbols), turns, blank, duplicate, truncated, illegal, distinct, low, high))
        symbols, turns, low, high = [], [], None, None
        size = blank = duplicate = truncated = illegal = distinct = 0

    for batch in batches:
        for conv_id, turn, role, text, symbol, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if started and conv_id != conv:
                close()
                segment, last_turn, last_initial = 0, None, None
            elif started and size >= SEGMENT_CHARS:
                close()
                segment += 1
            conv, started = conv_id, True
            if symbol is None:  # only says that the conversation exists
                continue
            symbols.append(symbol)
            turns.append({"role": role, "text": text})
            size += len(role) + len(text)
            blank += fault == "blank"
            duplicate += fault == "duplicate"
            truncated += fault == "truncated"
            initial = role[:1]
            illegal += last_initial is not None and last_initial + initial not in ("su", "ua", "au")
            last_initial = initial
            if turn is not None:
                distinct += turn != last_turn
                last_turn = high = turn
                low = turn if low is None else low
        if out:
            yield _emit(out, _segment)
    if started:
        close()
        yield _emit(out, _segment)


def _step(symbol: str, rest: tuple) -> tuple[list[int], bytes]:
    """Cost and first edit per grammar state of the node before ``symbol``, from the costs of the node behind it."""
    cost, edit = [], bytearray()
    cut = CUT if symbol.isupper() else 0
    after = _AFTER.get(symbol.lower(), (None,) * 4)
    for q in range(4):
        best, first = DELETE + rest[q], ord("D")
        if symbol != "-":
            if after[q] is not None and cut + rest[after[q]] < best:
                best, first = cut + rest[after[q]], ord("K")
            if REROLE + cut + rest[_TURN[q]] < best:
                best, first = REROLE + cut + rest[_TURN[q]], ord("R")
        cost.append(best)
        edit.append(first)
    # An insertion stays at the node; more than one in a row is of use only before the first turn.
    plain = list(cost)
    for q in (2, 3, 0, 1):
        inserted = INSERT + (cost[2] if q < 2 else plain[_TURN[q]])
        if inserted < cost[q] or inserted == cost[q] and edit[q] > ord("I"):
            cost[q], edit[q] = inserted, ord("I")
    return cost, bytes(edit)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reversed signatures in order: neighbours share the nodes of their common ending, which stay on the stack."""
    costs, edits, path = array("q", _END_COST), bytearray(_END_EDIT), ""
    for batch in batches:
        reverse = batch.column(0).to_pylist()
        found = []
        for signature in reverse:
            shared, limit = 0, min(len(path), len(signature))
            if path[:limit] == signature[:limit]:
                shared = limit
            else:
                while path[shared] == signature[shared]:
                    shared += 1
            del costs[4 * shared + 4 :], edits[4 * shared + 4 :]
            for symbol in signature[shared:]:
                cost, edit = _step(symbol, costs[-4:])
                costs.extend(cost)
                edits.extend(edit)
            path, audit, q, at = signature, bytearray(), 0, len(signature)
            while (edit := edits[4 * at + q]) != ord("."):
                audit.append(edit)
                if edit == ord("K"):
                    q = _AFTER[signature[at - 1].lower()][q]
                elif edit != ord("D"):
                    q = _TURN[q]
                at -= edit != ord("I")
            found.append((signature[::-1], costs[-4], audit.decode()))
        if found:
            names = ["signature", "cost", "edits"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names)


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """``(signature, cost, edits)`` of every distinct ``signature``.

    Symbols are s, u, a and o (another role), capital if the text is cut off, and - for a row that must go. Edits are
    K(eep), R(erole), D(elete) and I(nsert); among the cheapest the least string.
    """
    reverse = signatures.select(F.reverse("signature").alias("reverse")).distinct()
    ordered = reverse.repartitionByRange("reverse").sortWithinPartitions("reverse")
    return ordered.mapInArrow(_solve, "signature string, cost bigint, edits string")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row with a conversation's edits comes first, then its segments in order."""
    out: list[tuple] = []
    edits, facts, segments, at, q = "", (), 0, 0, 0
    for batch in batches:
        for conv, segment, symbols, turns, n, audit, *found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment < 0:
                edits, facts, segments, at, q = audit, tuple(found), n, 0, 0
                continue
            begun, kept = at, []

            def inserted():
                nonlocal at, q
                while edits.startswith("I", at):
                    kept.append({"role": _ROLE[q], "text": ""})
                    at, q = at + 1, _TURN[q]

            for symbol, turn in zip(symbols, turns, strict=True):
                inserted()
                if edits[at] == "K":
                    kept.append(turn)
                    q = _AFTER[symbol.lower()][q]
                elif edits[at] == "R":
                    kept.append({"role": _ROLE[q], "text": turn["text"]})
                    q = _TURN[q]
                at += 1
            if segment == segments - 1:
                inserted()
            out.append((conv, segment, edits[begun:at], kept, *facts))
        if out:
            yield _emit(out, _repaired)


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Edit conversations (conv_id, turn, role, text) so that role initials read ``(s?(ua)+)?``, as cheaply as possible.

    Returns segments in order: conv_id, segment (0 but for conversations of over a million characters), edits (their
    letters for the rows of the segment), turns (the repaired roles and texts), and per conversation gaps, blank,
    duplicate, truncated, illegal and cost. The segments of a conversation stay in one partition and in order.

    Rows go by turn (null first), ties by role, then text. A row's first fault counts: blank (no character but white
    space), duplicate (role and text seen earlier), truncated (the last such character is none of ``.!?``). Blank and
    duplicate rows are deleted. Null role or text: one space. Repeated rows are duplicates. Rows without conv_id form one
    conversation. Conversations named only in ``conversations`` come out empty. Extra columns are ignored; an empty table
    gives none.

    Equal signatures and equal endings are solved once, so copies of a conversation cost their texts only. A task streams
    through its conversations with one segment, and one byte per row of a conversation, in memory.
    """
    rows = turns.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))))
    rows = rows.fillna(" ", ["role", "text"]).withColumn("exists", F.lit(True))
    if conversations is not None:
        named = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
        rows = rows.unionByName(named.withColumn("exists", F.lit(False)), allowMissingColumns=True)
    seen = Window.partitionBy("conv_id", "exists", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    end = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(end == "", "blank")
        .when(F.row_number().over(seen) > 1, "duplicate")
        .when(~F.right(end, F.lit(1)).isin(*STOPS), "truncated")
    )
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(symbol)).otherwise(symbol)
    rows = rows.repartition("conv_id").withColumn("fault", fault)
    rows = rows.withColumn("symbol", F.when(F.col("exists"), symbol)).sortWithinPartitions("conv_id", "turn", "role", "text")
    segments = written(rows.select("conv_id", "turn", "role", "text", "symbol", "fault").mapInArrow(_segments, _SEGMENTS))

    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("distinct"), F.lit(0))
    parts = F.sort_array(F.collect_list(F.struct("segment", "symbols")))  # one character per row
    found = segments.groupBy("conv_id").agg(
        gaps.alias("gaps"), *sums, F.count(F.lit(1)).cast("int").alias("n"), F.array_join(parts["symbols"], "").alias("signature")
    )
    found = written(found)
    solved = found.join(written(cheapest_edits(found)), "signature")
    heads = solved.select("conv_id", F.lit(-1).alias("segment"), "n", "edits", *_FACTS)
    stream = segments.select("conv_id", "segment", "symbols", "turns").unionByName(heads, allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return stream.select("conv_id", "segment", "symbols", "turns", "n", "edits", *_FACTS).mapInArrow(_applied, REPAIRED)


_digest = pa.schema(
    [("conv_id", pa.int64())] + [(c, pa.int64()) for c in _FACTS] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    conv, facts, audit, digest, begun = None, None, [], None, False

    def close() -> None:
        out.append((conv, *facts, "".join(audit), digest.hexdigest()))

    for batch in batches:
        for conv_id, segment, edits, turns, *found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment == 0:
                if facts is not None:
                    close()
                conv, facts, audit, digest, begun = conv_id, found, [], hashlib.sha256(), False
            audit.append(edits)
            for turn in turns:
                digest.update((("\n" if begun else "") + turn["role"] + ":" + turn["text"]).encode())
                begun = True
        if out:
            yield _emit(out, _digest)
    if facts is not None:
        close()
        yield _emit(out, _digest)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract view: all conversations, damaged, repaired and digested."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    repaired = repair(damaged(turns), turns)
    schema = "conv_id bigint, " + ", ".join(f"{c} bigint" for c in _FACTS) + ", audit string, repaired_sha256 string"
    return repaired.mapInArrow(_digested, schema)
