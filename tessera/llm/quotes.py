"""Quotation linking: conversations in reply order, without quoted text.

Lines that begin with one or more ``>`` are quoted, at the level of that many
marks.  Consecutive lines of one level are a passage.  A passage is two
sequences, its lines and its paragraphs, each normalised (lower case, single
spaces, blank ones left out) and hashed; so is what a message says itself.  A
passage links to a message that has the passage's lines, or its paragraphs, one
after another among its own: any run of them, so parts of a message link as
well as all of it, and paragraphs link however their lines are wrapped.

Messages are ordered by conversation and turn.  A passage links to the earliest
such message of its own conversation if that came before, else to the earliest
such message of all if that came before.  A message replies to what its passages
of level 1 link to (those of any level if none of level 1 is linked): in its own
conversation if possible, the latest if there are several.

1. Messages are parsed once, in a narrow pass, and staged.
2. The first unit of each quoted run is its anchor.  Messages' units are joined
   to the anchors (units that very many messages have are joined by broadcast),
   and only at these places runs are hashed, of the lengths wanted there, each from two
   hashes of the message's beginnings.
3. Run hashes are summed to their earliest message, per conversation and over
   all, before they are shuffled, and joined to the quoted runs.
4. Threads are found by doubling: each message holds its topmost known ancestor
   and the steps up to it, so a state has one small row per linked message.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._text import column, slices, utf8
from tessera.plans.joins import left_join_hot
from tessera.plans.staging import Staging

SPACE = " \t\n\x0b\f\r"
#: Verbs that end the line above a quotation, as "... wrote:".
ATTRIBUTION = re.compile(f"(?:wrote|writes|schrieb|écrit|escribió)[{SPACE}]*:[{SPACE}]*$")
MARKS = re.compile(r"(?:[ \t]*>)+")
NEW = ["body", "n_quotes", "max_level", "n_linked", "parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth"]


def normalised(text: str) -> str:
    return re.sub(f"[{SPACE}]+", " ", text).strip(" ").lower()


def levels_of(text: str) -> list[tuple[int, str]]:
    """(level, content) of each line; the line that announces a quotation has empty content."""
    out: list[tuple[int, str]] = []
    for line in re.sub("\r\n?", "\n", text).split("\n"):
        marks = MARKS.match(line)
        if marks:
            if out and out[-1][0] == 0 and ATTRIBUTION.search(out[-1][1]):
                out[-1] = (0, "")
            out.append((marks[0].count(">"), line[marks.end() :].removeprefix(" ")))
        else:
            out.append((0, line))
    return out


def sequences(lines: list[str]) -> list[list[str]]:
    """The units of some lines: normalised lines and, if they differ, normalised paragraphs; blank ones left out."""
    plain = [normalised(x) for x in lines]
    units = [x for x in plain if x]
    paragraphs, begun = [], False
    for x in plain:
        if x and begun:
            paragraphs[-1] += " " + x
        elif x:
            paragraphs.append(x)
        begun = bool(x)
    return [s for s in ([units] if paragraphs == units else [units, paragraphs]) if s]


def parse_message(text: str) -> tuple[str, list[list[str]], list[tuple[int, list[list[str]]]]]:
    """The body, its sequences, and (level, sequences) of each passage that is not blank."""
    lines = levels_of(text)
    own = [c for level, c in lines if level == 0]
    passages, at = [], 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end][0] == lines[at][0]:
            end += 1
        if lines[at][0] and (found := sequences([c for _, c in lines[at:end]])):
            passages.append((lines[at][0], found))
        at = end
    return "\n".join(own).strip(SPACE), sequences(own), passages


def unit_hash(unit: str) -> int:
    return xxhash.xxh3_64_intdigest(unit.encode("utf-8", "surrogatepass")) - (1 << 63)


#: Run hashes are polynomials in this base modulo a prime of 127 bits; both are fixed, so that hashes of all tasks agree.
BASE, PRIME = 0x5D588B656C07896553F3C1E2A96B1D27, (1 << 127) - 1


class RunHashes:
    """Hashes of any run of a sequence of unit hashes, in constant time each, from those of its beginnings."""

    #: Powers of the base, as many as a process has needed so far.
    powers = [1]

    def __init__(self, hashes: list[int]):
        self.before = [0]
        for h in hashes:
            # No unit counts as 0, so a run's length is part of its hash.
            self.before.append((self.before[-1] * BASE + h + (1 << 63) + 1) % PRIME)
        while len(self.powers) <= len(hashes):
            self.powers.append(self.powers[-1] * BASE % PRIME)

    def run(self, at: int, length: int) -> bytes:
        return ((self.before[at + length] - self.before[at] * self.powers[length]) % PRIME).to_bytes(16, "little")


def run_hash(hashes: list[int]) -> bytes:
    """127 bits of a whole run of unit hashes."""
    return RunHashes(hashes).run(0, len(hashes))


def parse_messages(rows: DataFrame) -> DataFrame:
    """``rows`` (_text and others) with _body, _seqs (hashes of its sequences) and _passages instead of the text."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        kinds = (pa.string(), pa.list_(longs), pa.list_(pa.struct([("level", pa.int32()), ("runs", pa.list_(longs))])))
        for batch in slices(batches, "_text"):
            made = []
            for text in utf8(column(batch, "_text")):
                body, seqs, passages = parse_message((text or b"").decode())
                hashed = lambda several: [[unit_hash(u) for u in s] for s in several]
                made.append((body, hashed(seqs), [{"level": level, "runs": hashed(runs)} for level, runs in passages]))
            kept = [n for n in batch.schema.names if n != "_text"]
            new = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in kept), *new], [*kept, "_body", "_seqs", "_passages"])

    empty = rows.limit(0).drop("_text").withColumn("_body", F.lit("").cast("string"))
    empty = empty.withColumn("_seqs", F.array().cast("array<array<bigint>>")).withColumn("_passages", F.array().cast("array<struct<level:int,runs:array<array<bigint>>>>"))
    return rows.mapInArrow(parse, empty.schema)


def _quoted_runs(parsed: DataFrame) -> DataFrame:
    """(conv, turn, rid, no, level, m, first, key) of each run of each passage."""
    flat = parsed.where(F.size("_passages") > 0).select("conv", "turn", "rid", F.posexplode("_passages").alias("no", "p")).select("conv", "turn", "rid", "no", F.col("p.level").alias("level"), F.explode("p.runs").alias("run"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = column(batch, "run").to_pylist()
            kept = [n for n in batch.schema.names if n != "run"]
            new = [pa.array([len(r) for r in runs], pa.int32()), pa.array([r[0] for r in runs], pa.int64()), pa.array([run_hash(r) for r in runs], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in kept), *new], [*kept, "m", "first", "key"])

    schema = flat.limit(0).drop("run").withColumn("m", F.lit(0)).withColumn("first", F.lit(0).cast("long")).withColumn("key", F.lit(b""))
    return flat.mapInArrow(keyed, schema.schema)


def runs_of(seqs: list[list[int]], at: list[dict], wanted: list[dict]) -> set[bytes]:
    """The hashes of the runs of some sequences at places (seq, pos), of the ``lengths`` wanted for the unit ``first`` there."""
    lengths = {w["first"]: w["lengths"] for w in wanted}
    hashed = {k: RunHashes(seqs[k]) for k in {p["seq"] for p in at}}
    return {hashed[p["seq"]].run(p["pos"], m) for p in at for m in lengths[seqs[p["seq"]][p["pos"]]] if p["pos"] + m <= len(seqs[p["seq"]])}


def _runs_at(hits: DataFrame) -> DataFrame:
    """(conv, turn, key) of the runs of ``hits`` (conv, turn, _seqs, at: (seq, pos), wanted: (first, lengths), in arrays)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, keys = [], []
            for k, (seqs, places, wanted) in enumerate(zip(*(column(batch, c).to_pylist() for c in ("_seqs", "at", "wanted")), strict=True)):
                found = runs_of(seqs, places, wanted)
                take += [k] * len(found)
                keys += sorted(found)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([column(batch, "conv").take(at), column(batch, "turn").take(at), pa.array(keys, pa.binary())], ["conv", "turn", "key"])

    schema = hits.limit(0).select("conv", "turn").withColumn("key", F.lit(b""))
    return hits.mapInArrow(cut, schema.schema)


def find_origins(parsed: DataFrame, runs: DataFrame, staging: Staging, hot_share: int) -> DataFrame:
    """(key, conv, turn): of each quoted run and each conversation that says it, the earliest message with it; staged."""
    anchors = runs.groupBy("first").agg(F.collect_set("m").alias("lengths"))
    # Sequences and places of all messages; a unit that very many have is joined by broadcast.
    units = parsed.select("rid", F.posexplode("_seqs").alias("seq", "s")).select("rid", "seq", F.posexplode("s").alias("pos", "first"))
    weights = units.groupBy("first").agg(F.count("*").alias("weight"))
    anchors = staging.keep(anchors.join(weights, "first"), "anchors")
    total = parsed.agg(F.coalesce(F.sum(F.aggregate("_seqs", F.lit(0), lambda n, s: n + F.size(s))), F.lit(0))).first()[0]
    met = left_join_hot(units, anchors, ["first"], "weight", max(2, total // hot_share), F.xxhash64("rid", "pos")).where("lengths is not null")
    # A unit that a message repeats has its lengths there once.
    places = met.groupBy("rid").agg(F.collect_list(F.struct("seq", "pos")).alias("at"), F.collect_set(F.struct("first", "lengths")).alias("wanted"))
    hits = parsed.select("rid", "conv", "turn", "_seqs").join(places, "rid").select("conv", "turn", "_seqs", "at", "wanted")
    said = staging.keep(_runs_at(hits).groupBy("key", "conv").agg(F.min("turn").alias("turn")), "said")
    wanted = runs.select("key").distinct()
    return staging.keep(said.join(wanted, "key", "left_semi"), "origins")


def link_runs(runs: DataFrame, origins: DataFrame, hot: int) -> DataFrame:
    """(conv, turn, n_linked, parent_conv, parent_turn) of each message that is linked."""
    deal = F.xxhash64("rid", "no")
    many = runs.groupBy("key", "conv").agg(F.count("*").alias("n"))
    own = origins.join(many, ["key", "conv"]).withColumnRenamed("turn", "own_turn")
    first = origins.groupBy("key").agg(F.min(F.struct("conv", "turn")).alias("first_said")).join(many.groupBy("key").agg(F.sum("n").alias("n_all")), "key")
    linked = left_join_hot(left_join_hot(runs, own, ["key", "conv"], "n", hot, deal), first, ["key"], "n_all", hot, deal)
    here = F.when(F.col("own_turn") < F.col("turn"), F.struct(F.lit(True).alias("here"), "conv", F.col("own_turn").alias("turn")))
    there = F.when(F.col("first_said") < F.struct("conv", "turn"), F.struct(F.lit(False).alias("here"), F.col("first_said.conv").alias("conv"), F.col("first_said.turn").alias("turn")))
    linked = linked.withColumn("to", F.coalesce(here, there)).where("to is not null")
    # Of a passage's two runs the better link counts: in its own conversation, then the earliest.
    best = F.min(F.struct((~F.col("to.here")).alias("away"), F.col("to.conv").alias("c"), F.col("to.turn").alias("t")))
    passages = linked.groupBy("conv", "turn", "rid", "no", "level").agg(best.alias("b"))
    parent = F.max(F.struct((F.col("level") == 1).alias("direct"), (~F.col("b.away")).alias("here"), F.col("b.c").alias("c"), F.col("b.t").alias("t")))
    # Messages that share conversation and turn have the passages of either.
    links = passages.groupBy("conv", "turn").agg(F.count("*").cast("int").alias("n_linked"), parent.alias("p"))
    return links.select("conv", "turn", "n_linked", F.col("p.c").alias("parent_conv"), F.col("p.t").alias("parent_turn"))


def reply_threads(links: DataFrame, staging: Staging, hot_share: int) -> DataFrame:
    """(conv, turn, thread_conv, thread_turn, depth) of each link: its first ancestor and the steps up to it."""
    top = F.struct(F.col("parent_conv").alias("conv"), F.col("parent_turn").alias("turn"))
    state = staging.keep(links.select(F.struct("conv", "turn").alias("node"), top.alias("top"), F.lit(1).alias("depth")), "threads-0")
    hot, k = max(2, links.count() // hot_share), 0
    while True:
        pointed = state.groupBy("top").agg(F.count("*").alias("n"))
        up = state.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more")).join(pointed, "top")
        longer = left_join_hot(state, up, ["top"], "n", hot, F.xxhash64("node")).select("node", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        k += 1
        longer = staging.keep(longer, f"threads-{k}")
        staging.drop(f"threads-{k - 1}")
        if not longer.where("moved").limit(1).count():
            return longer.select("node.conv", "node.turn", F.col("top.conv").alias("thread_conv"), F.col("top.turn").alias("thread_turn"), "depth")
        state = longer.drop("moved")


def link_quotations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", hot_share: int = 2000) -> DataFrame:
    """The messages without quotations, in reply order.

    New columns: ``body``, ``n_quotes``, ``max_level``, ``n_linked``, ``parent_conv``,
    ``parent_turn``, ``thread_conv`` and ``thread_turn`` (the first message of the thread),
    ``depth`` (steps from there).  One row per input row, its other columns but
    the text included; rows are sorted by thread, conversation and turn, so every
    reply follows what it replies to.  A message without a parent begins a thread.  A
    null text has an empty body.  A message with a null conversation or turn is
    linked with nothing.  Messages that share conversation and turn are one message to
    those that quote them and share their links.  An empty table gives an empty
    result; a clash with the new names raises ValueError.
    """
    others = [c for c in df.columns if c not in (conv_col, turn_col, text_col)]
    if set(NEW) & set(df.columns):
        raise ValueError(f"the table has columns {sorted(set(NEW) & set(df.columns))}")
    staging = Staging(df.sparkSession, "quotes")
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.struct(F.lit(0).alias("_"), *others).alias("_others"), F.col(text_col).alias("_text"))
    parsed = staging.keep(parse_messages(rows), "parsed")
    placed = parsed.where("conv is not null and turn is not null")
    runs = staging.keep(_quoted_runs(placed), "runs")
    origins = find_origins(placed, runs, staging, hot_share)
    links = staging.keep(link_runs(runs, origins, max(2, runs.count() // hot_share)), "links")
    threads = reply_threads(links, staging, hot_share)
    found = staging.keep(links.join(threads, ["conv", "turn"]), "found")
    staging.drop("runs", "anchors", "said", "origins", "links")

    levels = F.transform("_passages", lambda p: p["level"])
    out = parsed.join(found, ["conv", "turn"], "left").select(
        F.col("conv").alias(conv_col),
        F.col("turn").cast(df.schema[turn_col].dataType).alias(turn_col),
        *[F.col(f"_others.`{c}`").alias(c) for c in others],
        F.col("_body").alias("body"),
        F.size("_passages").alias("n_quotes"),
        F.coalesce(F.array_max(levels), F.lit(0)).alias("max_level"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        "parent_conv",
        "parent_turn",
        F.coalesce("thread_conv", "conv").alias("thread_conv"),
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    order = ["thread_conv", "thread_turn", conv_col, turn_col]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)
