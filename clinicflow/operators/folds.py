"""Order-dependent computations: a state per key, changed row by row.

Rows of a key are sorted and streamed through a small `step` function inside a Spark task;
nothing is collected. Opening states travel as ordinary rows ahead of a key's first row, so
one shuffle by key is all a fold costs.

A key with more than `chunk_rows` rows is not left to one task. Its rows are cut into
chunks. Where a fold can say what a chunk does to any start (`summary`), each chunk is
summarised once, the summaries are chained, and the chunks run from their true starts: three
passes over the rows, however many chunks there are. Otherwise all chunks run at once from an assumed starting
state, and every chunk whose assumption proves wrong is run again from the corrected one. When
all assumptions hold the result is exactly the sequential one. Each round settles at least one
further chunk per key, so the loop always ends; how few rounds it takes depends on how well the
end of a chunk can be predicted for a start it has not run from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import islice, repeat
from typing import ClassVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clinicflow.operators.skew import CHUNK_ROWS, cut, hot_keys, split, written

State = tuple[int | None, ...]

BEFORE = -1  # the place of opening states, ahead of all chunks
LINES = 20_000  # lines of a summary in one Arrow batch


@dataclass(frozen=True)
class Fold:
    """What to fold.

    keys: columns that identify one sequence; order: columns that sort it (total order).
    state: names of the bigint state columns; `step(state, inputs)` gets them as a tuple, or
    None where the key has no opening state, and returns (next state, output values).
    guess: states whose value at the start of a chunk its first row claims to know, and the
    column with the claim.
    predict: where a chunk would end if it started from `now`, given that it ended at `end`
    when started from `assumed`. It must return the true end if `now` equals `assumed`; the
    better it is otherwise, the fewer rounds a hot key takes.
    part: the first input, if a key has parts with a number of their own (an item its batches): the
    name of the part a row touches, or NULL. Opening rows of parts carry their name there, and the
    number as the first state; the key's own opening row has an empty name. `step` then gets
    a third argument, the numbers by name, which it may change.
    summary: makes an empty summary of a chunk for the first state column, if the others never
    change. `add(inputs)` takes the rows in order; `shift` is what the chunk adds to a start,
    `moves()` the starts that end elsewhere, with their end less the shift, and `top` the value
    no state exceeds: rows must treat larger ones like it.
    """

    keys: Sequence[str]
    order: Sequence[str]
    inputs: Sequence[str]
    state: Sequence[str]
    outputs: T.StructType
    step: Callable[..., tuple[State | None, tuple]]
    part: str = ""
    guess: dict[str, str] = field(default_factory=dict)
    predict: Callable[[State, State, State], State] = lambda assumed, end, now: end
    summary: Callable[[], Summary] | None = None

    @property
    def parts(self) -> list[str]:
        return [self.part] if self.part else []


class Summary:
    """What a chunk does to any start: nothing, until a subclass says otherwise."""

    top: ClassVar[int | None] = None
    shift: int = 0
    unset: int | None = None  # where a start that is not known ends

    def add(self, inputs: tuple) -> None:
        raise NotImplementedError

    def moves(self) -> Iterator[tuple[int, int]]:
        raise NotImplementedError


def _stream(
    rows: DataFrame, opening: DataFrame | None, keys: Sequence[str], fold: Fold
) -> DataFrame:
    """Opening states followed by rows, one key after the other, in order."""
    both = rows.withColumn("_kind", F.lit(1))
    if opening is not None:
        opened = opening.select(*keys, *fold.parts, *fold.state, F.lit(0).alias("_kind"))
        both = opened.unionByName(both, allowMissingColumns=True)
    lead = [*keys, "_kind", *fold.state, *fold.inputs]
    rest = [c for c in both.columns if c not in lead]
    return (
        both.select(*lead, *rest)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "_kind", *fold.order)
    )


def _walk(
    fold: Fold, n_keys: int, batches: Iterator[pa.RecordBatch], emit: Callable
) -> Iterator[pa.RecordBatch]:
    """Run the steps over sorted batches, carrying the state from batch to batch.

    Batches begin with `n_keys` key columns, the kind, the state and the input columns.
    """
    n_state, n_inputs = len(fold.state), len(fold.inputs)
    step, parted = fold.step, bool(fold.part)
    current: tuple | None = None
    state: State | None = None
    parts: dict[str, int | None] = {}
    for batch in batches:
        kinds = _values(batch.column(n_keys))
        opened = batch.filter(pc.equal(batch.column(n_keys), 0))
        first, after = n_keys + 1, n_keys + 1 + n_state
        states = _tuples(opened, range(first, after))
        key_rows = _tuples(batch, range(n_keys))
        values = _tuples(batch, range(after, after + n_inputs))
        outputs: list[tuple] = []
        ended: list[tuple] = []
        for key, kind, inputs in zip(key_rows, kinds, values):
            if key != current:
                if current is not None:
                    ended.append((current, state, parts))
                current, state, parts = key, None, {}
            if kind == 0:
                opening = next(states)
                if parted and inputs[0]:
                    parts[inputs[0]] = opening[0]
                else:
                    state = opening
            else:
                state, out = step(state, inputs, parts) if parted else step(state, inputs)
                outputs.append(out)
        yield from emit(batch, outputs, ended)
    if current is not None:
        yield from emit(None, [], [(current, state, parts)])


def _values(column: pa.Array) -> list:
    """The column as Python values; whole numbers, flags and texts that repeat take a faster way."""
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        words = [*coded.dictionary.to_pylist(), None]
        return [words[i] for i in pc.fill_null(coded.indices, len(words) - 1).to_numpy().tolist()]
    plain = pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)
    if not plain:
        return column.to_pylist()
    if column.null_count == 0:
        return column.to_numpy(zero_copy_only=False).tolist()
    filled = pc.fill_null(column, pa.scalar(0).cast(column.type))
    present = column.is_valid().to_numpy(zero_copy_only=False).tolist()
    values = filled.to_numpy(zero_copy_only=False).tolist()
    return [value if there else None for value, there in zip(values, present)]


def _tuples(batch: pa.RecordBatch, places: range) -> Iterator[tuple]:
    """The rows of some columns as tuples; endless empty ones for no columns."""
    return zip(*[_values(batch.column(i)) for i in places]) if places else repeat(())


def _columns(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    values = zip(*rows) if rows else [[] for _ in schema]
    return [pa.array(list(v), type=f.type) for v, f in zip(values, schema)]


def _fold_rows(stream: DataFrame, rows: DataFrame, keys: Sequence[str], fold: Fold) -> DataFrame:
    """Every row with the outputs of its step."""
    schema = T.StructType([*rows.schema.fields, *fold.outputs.fields])
    arrow = to_arrow_schema(schema)
    out_arrow = to_arrow_schema(fold.outputs)
    kept = rows.columns
    n_keys = len(keys)

    def emit(batch, outputs, _ended):
        if batch is None or not outputs:
            return
        mask = pc.equal(batch.column(n_keys), 1)
        taken = batch.filter(mask)
        arrays = [taken.column(c).cast(arrow.field(c).type) for c in kept]
        yield pa.RecordBatch.from_arrays([*arrays, *_columns(outputs, out_arrow)], schema=arrow)

    return stream.mapInArrow(lambda batches: _walk(fold, n_keys, batches, emit), schema)


def _fold_ends(stream: DataFrame, keys: Sequence[str], fold: Fold) -> DataFrame:
    """One row per key with the state after its last row, all NULL where there is none, and one per part."""
    fields = [stream.schema[k] for k in [*keys, *fold.parts]]
    fields += [T.StructField(s, T.LongType()) for s in fold.state]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    nothing = (None,) * len(fold.state)
    own = ("",) if fold.part else ()
    n_keys = len(keys)

    def emit(_batch, _outputs, ended):
        rows = []
        for key, state, parts in ended:
            rows.append((*key, *own, *(state or nothing)))
            rows += [(*key, name, number, *nothing[1:]) for name, number in parts.items()]
        if rows:
            yield pa.RecordBatch.from_arrays(_columns(rows, arrow), schema=arrow)

    return stream.mapInArrow(lambda batches: _walk(fold, n_keys, batches, emit), schema)


def run_fold(
    rows: DataFrame,
    opening: DataFrame | None,
    fold: Fold,
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Fold `rows` from the states in `opening` (one row per key and part); returns rows + outputs.

    Without `opening` every key starts with no state, which is then any value `step` likes.
    `chunk_rows` is None where the rows of a key are bounded by construction.
    """
    hot = hot_keys(rows, fold.keys, chunk_rows) if chunk_rows else None
    if hot is None:
        stream = _stream(rows, opening, fold.keys, fold)
        return _fold_rows(stream, rows, fold.keys, fold)
    cold_rows, hot_rows = split(rows, hot, fold.keys)
    cold_open, hot_open = split(opening, hot, fold.keys) if opening is not None else (None, None)
    cold = _fold_rows(_stream(cold_rows, cold_open, fold.keys, fold), rows, fold.keys, fold)
    return cold.unionByName(_run_chunked(hot_rows, hot_open, hot, fold, chunk_rows))


def _same(left: str, right: str, pairs: dict[str, str]) -> Column:
    """Equality of columns that may be NULL."""
    return reduce(Column.__and__, [F.col(f"{left}.{a}").eqNullSafe(F.col(f"{right}.{b}")) for a, b in pairs.items()])


def _summaries(chunked: DataFrame, fold: Fold) -> DataFrame:
    """(keys, chunk, start, end, shift): one line per chunk with its shift, and one per start that moves."""
    by_chunk = [*fold.keys, "_chunk"]
    fields = [T.StructField(n, T.LongType()) for n in ("_start", "_end", "_shift")]
    schema = T.StructType([*[chunked.schema[k] for k in by_chunk], *fields])
    arrow = to_arrow_schema(schema)
    n_keys, make = len(by_chunk), fold.summary

    def told(key: tuple, summary: Summary) -> Iterator[tuple]:
        yield *key, None, None, summary.shift
        if summary.unset is not None:
            yield *key, None, summary.unset, None
        yield from ((*key, start, end, None) for start, end in summary.moves())

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, summary = None, None
        for batch in batches:
            inputs = _tuples(batch, range(n_keys, n_keys + len(fold.inputs)))
            for key, row in zip(_tuples(batch, range(n_keys)), inputs):
                if key != current:
                    if current is not None:
                        yield from told(current, summary)
                    current, summary = key, make()
                summary.add(row)
        if current is not None:
            yield from told(current, summary)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lines(batches)
        while some := list(islice(out, LINES)):
            yield pa.RecordBatch.from_arrays(_columns(some, arrow), schema=arrow)

    lead = chunked.select(*by_chunk, *fold.inputs, *[c for c in fold.order if c not in fold.inputs])
    return lead.repartition(*by_chunk).sortWithinPartitions(*by_chunk, *fold.order).mapInArrow(summarise, schema)


def _chained(chunked: DataFrame, opening: DataFrame, fold: Fold, chunk_rows: int) -> DataFrame:
    """(keys, chunk, state): the true start of every chunk of the keys in `opening`.

    Values are counted without the shifts of the chunks before, so a value stays what it is until a
    chunk moves it. The values a chunk can leave are joined to the next chunk that moves them: per
    value these are at most two rows a chunk, whatever the key. What is left is a chain of links
    from the opening value, see `_path`.
    """
    keys, first = list(fold.keys), fold.state[0]
    by_chunk = [*keys, "_chunk"]
    lines = written(_summaries(chunked, fold))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = lines.filter("_shift is not null").select(
        *by_chunk, F.coalesce(F.sum("_shift").over(earlier), F.lit(0)).alias("_base")
    )
    moves = lines.filter("_shift is null").alias("l").join(
        heads.alias("h"), _same("l", "h", {c: c for c in by_chunk})
    ).select(*[F.col(f"l.{c}") for c in by_chunk], (F.col("_start") - F.col("_base")).alias("_value"),
             F.struct(F.col("l._chunk").alias("at"), (F.col("_end") - F.col("_base")).alias("value")).alias("_move"))
    begins = opening.select(*keys, F.lit(BEFORE).cast("bigint").alias("_chunk"), F.col(first).alias("_value"))
    left = moves.select(*by_chunk, F.col("_move.value").alias("_value")).distinct().unionByName(begins)
    later = Window.partitionBy(*keys, "_value").orderBy(F.desc("_chunk")).rangeBetween(Window.unboundedPreceding, -1)
    links = (
        left.unionByName(moves, allowMissingColumns=True)
        .withColumn("_next", F.last("_move", ignorenulls=True).over(later))
        .filter("_move is null and _next is not null")
        .select(*by_chunk, "_value", F.col("_next.at").alias("_at"), F.col("_next.value").alias("_to"))
    )
    path = _path(written(links), keys, chunk_rows).unionByName(begins)
    marks = heads.unionByName(
        path.select(*by_chunk, F.struct("_value").alias("_left")), allowMissingColumns=True
    )
    upto = Window.partitionBy(*keys).orderBy("_chunk").rangeBetween(Window.unboundedPreceding, -1)
    start, top = F.col("_from._value") + F.col("_base"), fold.summary.top
    starts = (
        marks.withColumn("_from", F.last("_left", ignorenulls=True).over(upto))
        .filter("_base is not null and _from is not null")
        .select(*by_chunk, (start if top is None else F.when(start > top, top).otherwise(start)).alias(first))
    )
    return starts.alias("s").join(opening.alias("o"), _same("s", "o", {k: k for k in keys})).select(
        *[F.col(f"s.{c}") for c in [*by_chunk, first]], *[F.col(f"o.{s}") for s in fold.state[1:]]
    )


def _path(links: DataFrame, keys: Sequence[str], chunk_rows: int) -> DataFrame:
    """(keys, chunk, value) of all values reached from the keys' opening values.

    A link leads from a value that a chunk leaves to the chunk that next moves it and the value
    it becomes. The links of a key are followed in one task if they are at most `chunk_rows`.
    Before that, links are taken out round by round: about a quarter of them, drawn by hash so that no two follow each
    other, and links to one that is out lead on to where that one leads. What they skipped
    comes back level by level once the rest has been followed.
    """
    node = [*keys, "_chunk", "_value"]
    target = [*keys, F.col("_at").alias("_chunk"), F.col("_to").alias("_value")]
    levels = [links]
    while not levels[-1].groupBy(*keys).count().filter(F.col("count") > chunk_rows).isEmpty():
        heads, tails = [
            F.xxhash64(F.lit(len(levels)), chunk, value).bitwiseAND(1) == 1
            for chunk, value in (("_chunk", "_value"), ("_at", "_to"))
        ]
        out = heads & ~tails & (F.col("_chunk") > BEFORE)
        rest, gone = levels[-1].filter(~out).alias("r"), levels[-1].filter(out).alias("g")
        skips = F.col("g._at").isNotNull()
        follows = _same("r", "g", {**{k: k for k in keys}, "_at": "_chunk", "_to": "_value"})
        levels.append(written(rest.join(gone, follows, "left").select(
            *[F.col(f"r.{c}") for c in node],
            *[F.when(skips, F.col(f"g.{c}")).otherwise(F.col(f"r.{c}")).alias(c) for c in ("_at", "_to")],
        )))
    walk = Fold(
        keys=keys,
        order=["_chunk"],
        inputs=["_chunk", "_value", "_at", "_to"],
        state=[],
        outputs=T.StructType([T.StructField("_followed", T.BooleanType())]),
        step=_follow,
    )
    reached = run_fold(levels[-1], None, walk, chunk_rows=None).filter("_followed").select(*node)
    for level in reversed(levels):
        passed = level.alias("l").join(reached.alias("n"), _same("l", "n", {c: c for c in node}), "left_semi")
        reached = written(reached.unionByName(passed.select(*target)).distinct())
    return reached.filter(F.col("_chunk") > BEFORE)


def _follow(at: tuple | None, link: tuple) -> tuple[tuple | None, tuple]:
    chunk, value, *to = link
    if chunk == BEFORE or (chunk, value) == at:
        return tuple(to), (True,)
    return at, (False,)


def _run_chunked(
    rows: DataFrame, opening: DataFrame | None, hot: DataFrame, fold: Fold, chunk_rows: int
) -> DataFrame:
    keys = list(fold.keys)
    by_chunk = [*keys, "_chunk"]
    chunked = cut(rows, hot, keys, fold.order, chunk_rows)
    if opening is None:
        fields = [rows.schema[k] for k in [*keys, *fold.parts]]
        fields += [T.StructField(s, T.LongType()) for s in fold.state]
        opening = rows.sparkSession.createDataFrame([], T.StructType(fields))
    if fold.summary is not None:
        stream = _stream(chunked, _chained(chunked, opening, fold, chunk_rows), by_chunk, fold)
        return _fold_rows(stream, chunked, by_chunk, fold).drop("_chunk")
    starts = _first_starts(chunked, opening, fold)
    pending, ends = starts, None
    while True:
        again = pending.select(*by_chunk).distinct()
        todo = chunked.join(again, by_chunk, "left_semi")
        opened = starts.filter("_known").join(again, by_chunk, "left_semi")
        fresh = _fold_ends(_stream(todo, opened, by_chunk, fold), by_chunk, fold)
        if ends is not None:
            fresh = fresh.unionByName(ends.join(again, by_chunk, "left_anti"))
        ends = written(fresh)
        starts = written(_corrected_starts(starts, ends, fold))
        pending = starts.filter("_wrong")
        if pending.isEmpty():
            break
    stream = _stream(chunked, starts.filter("_known"), by_chunk, fold)
    return _fold_rows(stream, chunked, by_chunk, fold).drop("_chunk")


def _first_starts(chunked: DataFrame, opening: DataFrame, fold: Fold) -> DataFrame:
    """A starting state for every chunk: the opening one, or what its first row claims.

    Parts get one for each chunk whose rows name them; those without an opening row have none.
    """
    by_chunk = [*fold.keys, "_chunk"]
    first_row = F.struct(*fold.order)
    claims = [F.min_by(c, first_row).alias(f"_claim_{s}") for s, c in fold.guess.items()]
    chunks = chunked.groupBy(*by_chunk).agg(F.count("*").alias("_rows"), *claims)
    opened = opening.select(*fold.keys, *fold.parts, *fold.state, F.lit(True).alias("_known"))
    own = opened.filter(F.col(fold.part) == "").drop(fold.part) if fold.part else opened
    later = F.col("_known") & (
        F.row_number().over(Window.partitionBy(*fold.keys).orderBy("_chunk")) > 1
    )
    claimed = {
        s: F.when(later, F.col(f"_claim_{s}")).otherwise(F.col(s)) for s in fold.guess
    }
    starts = chunks.join(own, list(fold.keys), "left").withColumns(claimed)
    if fold.part:
        named = chunked.filter(F.col(fold.part).isNotNull()).select(*by_chunk, fold.part).distinct()
        of_parts = named.join(opened, [*fold.keys, fold.part])
        starts = starts.withColumn(fold.part, F.lit("")).unionByName(of_parts, allowMissingColumns=True)
    return written(starts.select(*by_chunk, *fold.parts, *fold.state, "_known"))


def _corrected_starts(starts: DataFrame, ends: DataFrame, fold: Fold) -> DataFrame:
    """Where each chunk should start: one pass over the chunks, a few numbers each.

    A chunk starts where the one before is predicted to end. If that is where it was assumed
    to start, its end is known; otherwise it is marked `_wrong` and must run again. When no
    chunk is wrong, every start is the true end of the chunk before.
    """
    keys, n = [*fold.keys, *fold.parts], len(fold.state)
    found = ends.select(*keys, "_chunk", *[F.col(s).alias(f"_end_{s}") for s in fold.state])
    outputs = [T.StructField(f"_now_{s}", T.LongType()) for s in fold.state]
    chain = Fold(
        keys=keys,
        order=["_chunk"],
        inputs=["_known", "_own", *fold.state, *[f"_end_{s}" for s in fold.state]],
        state=[],
        outputs=T.StructType([*outputs, T.StructField("_wrong", T.BooleanType())]),
        step=partial(_next_start, n, fold.predict),
    )
    own = F.col(fold.part) == "" if fold.part else F.lit(True)
    chunks = starts.select(*keys, "_chunk", *fold.state, "_known", own.alias("_own")).join(found, [*keys, "_chunk"])
    ran = run_fold(chunks, None, chain, chunk_rows=None)
    now = [F.col(f"_now_{s}").alias(s) for s in fold.state]
    return ran.select(*keys, "_chunk", *now, "_known", "_wrong")


def _next_start(
    n: int, predict: Callable, now: State | None, row: tuple
) -> tuple[State | None, tuple]:
    known, own, assumed, end = row[0], row[1], row[2 : n + 2], row[n + 2 :]
    if not known:
        return None, (*assumed, False)
    now = assumed if now is None else now
    return (predict if own else _part_from)(assumed, end, now), (*now, now != assumed)


def _part_from(assumed: State, end: State, now: State) -> State:
    """The number of a part shifts with its start, and does not fall below nothing."""
    number = end[0] if now[0] == assumed[0] or None in (end[0], now[0]) else max(end[0] + now[0] - assumed[0], 0)
    return (number, *end[1:])
