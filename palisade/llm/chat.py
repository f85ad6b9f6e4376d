"""Chat formatting: a hidden Markov model over speaker-marker and line features recovers roles before turns are rendered."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palisade.llm.shared import written

ROLES = ("system", "user", "assistant")
#: Names that speakers go by at the start of a line, by role.
NAMES = {"system": 0, "instructions": 0, "user": 1, "human": 1, "customer": 1, "prompter": 1, "assistant": 2, "ai": 2, "bot": 2, "agent": 2, "model": 2}
MARKER = re.compile(r"\s*(?:#+\s*|\*\*|\[|<\|?(?:im_start\|?>)?)?(" + "|".join(NAMES) + r")\s*(?:\*\*\s*:|:\s*\*\*|\|?>|\]\s*:?|:)\s*", re.I)
#: Values of each feature: marker (none or a role's), place in its row, length, question, list or code, conversation start.
WIDTHS = (4, 4, 10, 2, 2, 2)
ROWS_A_CHUNK = 256
NEVER = -1e9
#: Lines that a role is taken to have of all roles' kind, and the share of lines with a marker of their own.
BACKED, OWN_MARKER = 10.0, 0.04


def features(line: str, place: int, first: bool) -> tuple[int, ...]:
    m = MARKER.match(line)
    return (NAMES[m[1].lower()] + 1 if m else 0, min(place, 3), min(len(line).bit_length(), 9), int(line.rstrip().endswith("?")), int(line.lstrip().startswith(("-", "*", "```", ">", "1."))), int(first))


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    change: np.ndarray
    emit: tuple[np.ndarray, ...]

    def scores(self, seen: tuple[int, ...]) -> np.ndarray:
        return sum(table[:, x] for table, x in zip(self.emit, seen, strict=True))

    @cached_property
    def steps(self) -> dict[tuple[int, ...], np.ndarray]:
        return {}

    def step(self, seen: tuple[int, ...]) -> np.ndarray:
        """Best log-probabilities from a role, or from the start (last row), to a line's role; one for each of the few combinations of features."""
        if (found := self.steps.get(seen)) is None:
            found = self.steps[seen] = self.new_step(seen)
        return found

    def new_step(self, seen: tuple[int, ...]) -> np.ndarray:
        """Inside a row only a marker changes the speaker."""
        move = self.change if seen[0] or not seen[1] else np.where(np.eye(len(ROLES), dtype=bool), 0.0, NEVER)
        return np.vstack([move, self.start]) + self.scores(seen)


def laid(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation, turn and text, with ``conv`` (its key), ``chunk`` and ``ord``; a conversation of any length is cut into chunks."""

    def number(batches):
        at, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            place = np.arange(n, n + len(batch))
            yield batch.assign(chunk=at + place // ROWS_A_CHUNK, ord=place)
            n += len(batch)

    keys = ["conv", "turn", F.xxhash64("text")]
    rows = rows.select(F.xxhash64("conv_id").alias("conv"), "conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInPandas(number, rows.schema.add("chunk", "long").add("ord", "long"))


def lines_of(texts: list[str | None], opens: bool) -> list[tuple[int, str, tuple[int, ...]]]:
    """Row number, line and features of the lines of a chunk's texts."""
    out = []
    for n, text in enumerate(texts):
        for place, line in enumerate((text or "").split("\n")):
            out.append((n, line, features(line, place, opens and n == 0 and place == 0)))
    return out


def learn(laid_rows: DataFrame) -> Model:
    """Counts over all rows whose role is known, summed by Spark into a table of fixed size, smoothed by all roles' counts; markers are taken to say their role, mostly."""

    def count(batches):
        emit = [np.zeros((len(ROLES), w), np.int64) for w in WIDTHS]
        change = np.zeros((len(ROLES) + 1, len(ROLES)), np.int64)
        last = None
        for batch in batches:
            for conv, chunk, role, text in zip(batch["conv"], batch["chunk"], batch["role"], batch["text"], strict=True):
                state = ROLES.index(role) if role in ROLES else None
                if state is not None:
                    for place, line in enumerate((text or "").split("\n")):
                        for table, x in zip(emit, features(line, place, last is None or last[0] != conv), strict=True):
                            table[state, x] += 1
                    if last and last[:2] == (conv, chunk) and last[2] is not None:
                        change[last[2], state] += 1
                last = (conv, chunk, state)
        rows = [(k, i, j, int(v)) for k, t in enumerate([change, *emit]) for (i, j), v in np.ndenumerate(t) if v]
        yield pd.DataFrame(rows, columns=["kind", "i", "j", "n"])

    inside = laid_rows.select("conv", "chunk", "role", "text").mapInPandas(count, "kind int, i int, j int, n long")
    # Between chunks, and from the start: the first and last role of each chunk.
    ends = laid_rows.groupBy("conv", "chunk").agg(F.min_by("role", "ord").alias("first"), F.max_by("role", "ord").alias("last"))
    ends = ends.withColumns({"before": F.lag("last").over(o := Window.partitionBy("conv").orderBy("chunk")), "k": F.row_number().over(o)})
    state = lambda c: F.array_position(F.array(*map(F.lit, ROLES)), F.col(c)).cast("int") - 1
    edges = ends.select(F.lit(0).alias("kind"), F.when(F.col("k") == 1, len(ROLES)).otherwise(state("before")).alias("i"), state("first").alias("j"), F.lit(1).cast("long").alias("n"))
    counts = inside.unionByName(edges.where("i >= 0 and j >= 0")).groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).collect()
    change = np.zeros((len(ROLES) + 1, len(ROLES)))
    emit = [np.zeros((len(ROLES), w)) for w in WIDTHS]
    for r in counts:
        ([change, *emit][r["kind"]])[r["i"], r["j"]] += r["n"]
    change += 3 * (change.sum(axis=0) + 0.5) / (change.sum() + 0.5 * len(ROLES))
    # Values that a role wasn't seen with are as likely as among all roles, so a rare role gains nothing by them.
    emit = [t + BACKED * (t.sum(axis=0) + 0.5) / (t.sum() + 0.5 * t.shape[1]) for t in emit]
    # A marker says its own role, mostly: as likely for each role, however few of its lines are known.
    strength = max(1000.0, emit[0].sum(axis=1).max())
    for state_ in range(len(ROLES)):
        prior = np.full(len(ROLES) + 1, OWN_MARKER / 50)
        prior[state_ + 1] = OWN_MARKER
        prior[0] = 1 - prior[1:].sum()
        emit[0][state_] += strength * prior
    log = lambda t: np.log(t / t.sum(axis=1, keepdims=True))
    change = log(change)
    return Model(change[-1], change[:-1], tuple(log(t) for t in emit))


def per_chunk(rows: DataFrame, f, schema: str) -> DataFrame:
    """``f(part, a, b)`` of each (conv, chunk), many chunks to a group: the chunk is rows a to b of ``part``; chunks have a bounded number of rows."""
    n = max(1, rows.count() // 20_000)
    names = StructType.fromDDL(schema).names

    def group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["conv", "chunk", "ord"])
        new = (np.diff(part["conv"].to_numpy()) != 0) | (np.diff(part["chunk"].to_numpy()) != 0)
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(part)]]).tolist()
        part = {c: part[c].tolist() if part[c].dtype == object else part[c].array for c in part}
        out = [row for a, b in zip(cuts[:-1], cuts[1:], strict=True) for row in f(part, a, b)]
        return pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in zip(names, zip(*out, strict=True), strict=True)})

    return rows.withColumn("_part", F.pmod(F.xxhash64("conv", "chunk"), F.lit(n))).groupBy("_part").applyInPandas(group, schema)


def format_chats(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, segment, role, text, rendered``: the turns of transcripts, with roles found by Viterbi.

    ``rows``: ``conv_id, turn, role, text``; roles train the model and are no input of decoding. The states of
    the lines of a conversation are found together; a row is cut where a line with a speaker marker changes the
    speaker, and markers are taken off. ``rendered`` is ``<|role|>``, the text and ``<|end|>``, on lines of their own.
    A conversation is decoded in chunks joined by max-plus matrices, so one that holds most rows is no single
    task. Null texts are empty ones; a null or empty text is one segment. Null conversations are one conversation;
    a null turn comes first; rows that tie in turn go by a hash of the text; repeated rows stay. Roles beyond the three teach
    nothing. An empty table gives no rows; other columns are ignored.
    """
    table = written(laid(rows), "chats")
    model = learn(table)
    first = table.groupBy("conv").agg(F.min("chunk").alias("head"))
    opened = table.join(first, "conv").withColumn("opens", F.col("chunk") == F.col("head")).drop("head", "role")
    # As strings, so that pandas keeps null and large numbers as they are.
    opened = opened.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})

    def product(part, a: int, b: int):
        best = None
        for _, _, seen in lines_of(part["text"][a:b], bool(part["opens"][a])):
            step = model.step(seen)
            best = step if best is None else (best[:, :, None] + step[None, :-1]).max(axis=1)
        yield part["conv"][a], part["chunk"][a], best.ravel()

    matrices = per_chunk(opened, product, "conv long, chunk long, best array<double>")

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        part = part.sort_values(["conv", "chunk"])
        convs, chunks, matrices = (part[c].tolist() for c in ("conv", "chunk", "best"))
        cuts = [0, *(np.flatnonzero(np.diff(part["conv"].to_numpy())) + 1).tolist(), len(convs)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            score, back = None, []
            for m in matrices[a:b]:
                m = np.asarray(m, float).reshape(len(ROLES) + 1, -1)
                total = m[-1:] if score is None else score[:, None] + m[:-1]
                back.append(total.argmax(axis=0))
                score = total.max(axis=0)
            state, ends = int(score.argmax()), []
            for x in reversed(back):
                ends.append(state)
                state = int(x[state])
            ends.reverse()
            out.extend(zip(convs[a:b], chunks[a:b], [-1, *ends[:-1]], ends, strict=True))
        return pd.DataFrame(out, columns=["conv", "chunk", "enter", "leave"])

    # Chunks of a conversation stay together: nine numbers and a few more each.
    matrices = written(matrices, "matrices")
    n = F.lit(max(1, matrices.count() // 20_000))
    ends = matrices.withColumn("_part", F.pmod(F.xxhash64("conv"), n)).groupBy("_part").applyInPandas(scan, "conv long, chunk long, enter int, leave int")

    def decode(part, a: int, b: int):
        found = lines_of(part["text"][a:b], bool(part["opens"][a]))
        enter, state = int(part["enter"][a]), int(part["leave"][a])
        score, back = None, []
        for _, _, seen in found:
            step = model.step(seen)
            total = step[[enter]] if score is None else score[:, None] + step[:-1]
            back.append(total.argmax(axis=0))
            score = total.max(axis=0)
        states = []
        for x in reversed(back):
            states.append(state)
            state = int(x[state])
        out, last = [], None
        for (n, line, seen), role in zip(found, reversed(states), strict=True):
            if seen[0] == role + 1:
                line = line[MARKER.match(line).end() :]
            if last is not None and last == (n, role):
                out[-1][2].append(line)
            else:
                out.append((n, role, [line]))
            last = (n, role)
        segment = 0
        for i, (n, role, own) in enumerate(out):
            segment = segment + 1 if i and out[i - 1][0] == n else 0
            yield part["conv_id"][a + n], part["turn"][a + n], segment, ROLES[role], "\n".join(own)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in ("conv_id", "turn")}
    turns = per_chunk(opened.join(ends, ["conv", "chunk"]), decode, "conv_id string, turn string, segment int, role string, text string")
    turns = turns.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))
