"""Chat transcripts: a hidden Markov model over marker and line features finds who speaks, then turns are rendered.

Lines of a conversation are cut into chunks of bounded length. The best path through a chunk, for each state before it, is a
small matrix; chunks are joined by these matrices, so that a conversation of any length is decoded by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voucherlake.llm.staging import staged

ROLES = ("user", "assistant", "system")
#: Line numbers in one chunk.
SPAN = 4096
#: Turn numbers whose rows are numbered by one task.
TURNS = 1024
# Words before a colon (or >) that name a speaker.
MARKERS = {
    "user": "user human q question customer me you prompt client",
    "assistant": "assistant ai bot a answer agent model gpt response",
    "system": "system instructions context",
}
_MARKER = re.compile(r"\s*[*_#\[<|]{0,3}\s*([A-Za-z]{1,14})\s*[*_\]>|]{0,3}\s*(?::|>)[*_]{0,2}\s*")
_SPEAKER = {word: i for i, role in enumerate(ROLES) for word in MARKERS[role].split()}
#: Feature values: marker (none, each role, another word), length class, ends with a question mark, is a list or code line.
MARKED, LONG, ASKS, LISTED = len(ROLES) + 2, 5, 2, 2
STATES = 2 * len(ROLES)  # of each role: first line of a turn, further line


def marker(line: str) -> tuple[int, int]:
    """(class of the speaker marker, where the line goes on after it)."""
    found = _MARKER.match(line)
    if not found:
        return 0, 0
    role = _SPEAKER.get(found[1].lower())
    return (len(ROLES) + 1, 0) if role is None else (role + 1, found.end())


def observe(line: str) -> tuple[int, int, int, int]:
    bare = line.strip()
    size = 0 if not bare else 1 + (len(bare) > 40) + (len(bare) > 160) + (len(bare) > 640)
    return marker(line)[0], size, int(bare.endswith("?")), int(bare[:2] in ("- ", "* ", "``") or bare[:1].isdigit())


class Model:
    """Log probabilities, estimated from counts with one added. counts: of (feature, state, value) and ("to", state, state)."""

    def __init__(self, counts: dict[tuple[str, int, int], int]):
        def table(name: str, values: int) -> np.ndarray:
            rows = np.array([[counts.get((name, s, v), 0) for v in range(values)] for s in range(STATES)], float) + 1
            return np.log(rows / rows.sum(axis=1, keepdims=True))

        self.features = [table("marked", MARKED), table("long", LONG), table("asks", ASKS), table("listed", LISTED)]
        self.step = table("to", STATES)
        # a further line has the role of the line before
        for s in range(STATES):
            for t in range(1, STATES, 2):
                if s // 2 != t // 2:
                    self.step[s, t] = -np.inf
        first = np.array([counts.get(("first", s, 0), 0) + 1.0 if s % 2 == 0 else 0.0 for s in range(STATES)])
        with np.errstate(divide="ignore"):
            self.first = np.log(first / first.sum())

    def emit(self, lines: list[str]) -> np.ndarray:
        seen = np.array([observe(line) for line in lines], np.int64).reshape(-1, 4)
        return sum(table[:, seen[:, i]] for i, table in enumerate(self.features)).T

    def through(self, lines: list[str]) -> np.ndarray:
        """Best scores (state before or the start, state at the end) of a chunk: STATES + 1 rows."""
        scores = self.emit(lines)
        best = np.vstack([self.step, self.first]) + scores[0]
        for score in scores[1:]:
            best = (best[:, :, None] + self.step).max(axis=1) + score
        return best

    def path(self, lines: list[str], before: int | None, end: int | None) -> list[int]:
        """The best states of the lines, after the state `before` (None: the start) up to the state `end` (None: any)."""
        scores = self.emit(lines)
        best = (self.first if before is None else self.step[before]) + scores[0]
        came = []
        for score in scores[1:]:
            ways = best[:, None] + self.step
            came.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + score
        states = [int(best.argmax()) if end is None else end]
        for way in reversed(came):
            states.append(int(way[states[-1]]))
        return states[::-1]


def fit(labelled: DataFrame) -> Model:
    """From labelled lines (conv_id, line_no, line, role, starts): all are counted; only counts reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = np.array([observe(line) for line in batch["line"]], np.int64).reshape(-1, 4)
            state = batch["role"].map({r: 2 * i for i, r in enumerate(ROLES)}).to_numpy() + (~batch["starts"].to_numpy(bool)).astype(int)
            tables = [pd.DataFrame({"name": name, "state": state, "value": seen[:, i]}) for i, name in enumerate(("marked", "long", "asks", "listed"))]
            tables.append(pd.DataFrame({"name": "to", "state": state, "value": batch["next"]}).dropna())
            tables.append(pd.DataFrame({"name": "first", "state": state[batch["is_first"].to_numpy(bool)], "value": 0}))
            yield pd.concat(tables).groupby(["name", "state", "value"]).size().reset_index(name="n").astype({"state": int, "value": int})

    known = labelled.where(F.col("role").isin(*ROLES))
    number = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, 2 * i)]), F.col("role"))
    # followers are looked up inside a chunk: a chunk's last line has none, which costs one count in SPAN
    inside = Window.partitionBy("conv_id", F.floor(F.col("line_no") / SPAN)).orderBy("line_no")
    state = number + F.when(F.col("starts"), 0).otherwise(1)
    rows = known.withColumns({"next": F.lead(state).over(inside), "is_first": F.col("starts") & (F.col("line_no") == 0)})
    schema = "name string, state int, value int, n long"
    counted = rows.select("line", "role", "starts", "next", "is_first").mapInPandas(run, schema)
    return Model({(r["name"], r["state"], r["value"]): r["n"] for r in counted.groupBy("name", "state", "value").agg(F.sum("n").alias("n")).collect()})


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each (conv_id, chunk), which follow one another, as one frame; a group is a chunk, so it is bounded."""
    open_rows = None
    for batch in batches:
        if open_rows is not None:
            batch = pd.concat([open_rows, batch], ignore_index=True)
        if not len(batch):
            continue
        key = batch[["conv_id", "chunk"]].astype("Int64").fillna(-(2**62)).to_numpy(np.int64)
        change = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        for a, b in zip(change, change[1:]):
            yield batch.iloc[a:b]
        open_rows = batch.iloc[change[-1] :]
    if open_rows is not None and len(open_rows):
        yield open_rows


def _cut(lines: DataFrame) -> DataFrame:
    cut = lines.withColumn("chunk", F.floor(F.col("line_no") / SPAN))
    return cut.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "line_no", "line")


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """(conv_id, chunk, line_no, line, state) of every row of lines (conv_id long, line_no long, line)."""
    shared = lines.sparkSession.sparkContext.broadcast(model)
    slim = lines.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("line_no").cast("long").alias("line_no"), F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line")
    )
    cut = staged(_cut(slim), "lines")
    sizes = cut.groupBy("conv_id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low < high")
    long = cut.join(sizes, cut["conv_id"].eqNullSafe(sizes["conv_id"]), "left_semi")

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches):
            best = shared.value.through(group["line"].tolist())
            yield pd.DataFrame({"conv_id": group["conv_id"].iloc[:1].astype("Int64"), "chunk": group["chunk"].iloc[:1], "best": [best.ravel().tolist()]})

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        """The states before and at the end of each chunk of one conversation: a row per chunk."""
        rows = rows.sort_values("chunk")
        tables = [np.array(b).reshape(STATES + 1, STATES) for b in rows["best"]]
        score, came = tables[0][STATES], []
        for table in tables[1:]:
            ways = score[:, None] + table[:STATES]
            came.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        states = [int(score.argmax())]
        for way in reversed(came):
            states.append(int(way[states[-1]]))
        states.reverse()
        before = [None, *states[:-1]]
        return pd.DataFrame({"conv_id": rows["conv_id"].astype("Int64"), "chunk": rows["chunk"], "before": pd.array(before, "Int32"), "at_end": states})

    tables = long.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "line_no", "line")
    tables = tables.mapInPandas(through, "conv_id long, chunk long, best array<double>")
    known = tables.groupBy("conv_id").applyInPandas(ends, "conv_id long, chunk long, before int, at_end int")
    known = staged(known.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "before", "at_end"), "ends")
    joined = cut.join(known, cut["conv_id"].eqNullSafe(known["c"]) & (cut["chunk"] == known["k"]), "left").drop("c", "k")

    def path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _grouped(batches):
            before, end = group["before"].iloc[0], group["at_end"].iloc[0]
            states = shared.value.path(group["line"].tolist(), None if pd.isna(before) else int(before), None if pd.isna(end) else int(end))
            found = group[["conv_id", "chunk", "line_no", "line"]].assign(state=states)
            yield found.astype({"conv_id": "Int64"})

    dealt = joined.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "line_no", "line")
    return dealt.mapInPandas(path, "conv_id long, chunk long, line_no long, line string, state int")


def turns(lines: DataFrame, model: Model) -> DataFrame:
    """(conv_id, turn_no, role, first_line, n_lines, text, rendered): the turns of transcripts.

    lines: (conv_id, line_no from 0 up, line). A turn is a first line with the further lines of its role; the speaker marker of
    its first line is taken off. rendered: `<|role|>`, newline, text, newline, `<|end|>`. A null line is an empty one; rows
    that repeat a line number are read in the order of their texts; a null conv_id is a conversation of its own; other
    columns are not read; no lines give no turns.
    """
    decoded = staged(decode(lines, model), "states")
    starts = (F.col("state") % 2 == 0).cast("long")
    upto = Window.partitionBy("conv_id", "chunk").orderBy("line_no", "line").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = decoded.groupBy("conv_id", "chunk").agg(F.sum(starts).alias("own"))
    counts = counts.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("passed"))
    numbered = decoded.withColumn("here", F.sum(starts).over(upto))
    numbered = numbered.join(counts, numbered["conv_id"].eqNullSafe(counts["c"]) & (numbered["chunk"] == counts["k"]))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.floor(F.col("state") / 2).cast("int") + 1)
    rows = numbered.select("conv_id", (F.col("passed") + F.col("here") - 1).alias("turn_no"), role.alias("role"), "line_no", _bare().alias("line"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    told = rows.groupBy("conv_id", "turn_no").agg(
        F.min("role").alias("role"), F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), whole.alias("text")
    )
    return told.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>")))


def _bare():
    """The line without the marker of a known speaker, where it starts a turn."""
    words = "|".join(sorted(_SPEAKER, key=len, reverse=True))
    pattern = r"^\s*[*_#\[<|]{0,3}\s*(?i:" + words + r")\s*[*_\]>|]{0,3}\s*(?::|>)[*_]{0,2}\s*"
    return F.when(F.col("state") % 2 == 0, F.regexp_replace("line", pattern, "")).otherwise(F.col("line"))


def transcript(conversations: DataFrame) -> DataFrame:
    """(conv_id, line_no, line, role, starts): conversations (conv_id, turn, role, text) as raw transcripts, with the truth.

    Speaker markers come in four styles by conversation, and one turn in six has none. Lines are numbered from 0 up by a
    running sum over the rows of a conversation, in the order of turn (null before 0), role and text, so that each line has a number of
    its own and a chunk holds SPAN lines. The sum is taken by chunks of turns; a row that repeats is told as often as it stands.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int")
    names = {"user": ["User: ", "Human: ", "Q: ", "**User**: "], "assistant": ["Assistant: ", "AI: ", "A: ", "**Assistant**: "]}
    table = lambda r: F.element_at(F.array(*[F.lit(x) for x in names[r]]), style + 1)
    mark = F.when(F.col("role") == "user", table("user")).when(F.col("role") == "assistant", table("assistant")).otherwise(F.lit("System: "))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6)) == 0
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    placed = _first_lines(rows)
    cut = placed.select(
        "conv_id", "first", "role", F.when(bare, F.lit("")).otherwise(mark).alias("mark"), F.split("text", "\n").alias("lines")
    ).select("conv_id", "first", "role", "mark", F.posexplode("lines").alias("i", "line"))
    return cut.select(
        "conv_id",
        (F.col("first") + F.col("i")).alias("line_no"),
        F.when(F.col("i") == 0, F.concat("mark", "line")).otherwise(F.col("line")).alias("line"),
        "role",
        (F.col("i") == 0).alias("starts"),
    )


def _first_lines(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with `first`, the lines of the rows before in their conversation."""
    part = F.floor(F.coalesce("turn", F.lit(-1)) / TURNS)
    sized = rows.withColumns({"part": part, "n": F.size(F.split("text", "\n")).cast("long")})
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy("conv_id", "part").agg(F.sum("n").alias("own"))
    totals = totals.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("passed"))
    inside = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    here = sized.withColumn("here", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = here.join(totals, here["conv_id"].eqNullSafe(totals["c"]) & (here["part"] == totals["p"]))
    return joined.withColumn("first", F.col("passed") + F.col("here")).drop("part", "n", "c", "p", "passed", "here")
