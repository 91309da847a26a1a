"""Repair of conversation structure: the cheapest edits that give role initials `(s?(ua)+)?`.

Depth-first branch-and-bound over (turn, state): an explicit stack, lower bounds of what the rest costs, the best repair so far
(cost, audit) as the incumbent, and for each node the best prefix that has reached it. Bounds come from a relaxation (any
end is allowed) and grow as nodes are left, so that no node is searched again in vain.

A conversation of up to SEGMENT turns is one array, searched as a whole. Longer ones, of any length, are cut into segments by their turns'
places; each segment is searched by itself from every state to every state, and what is left is a chain of four states over segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from .common import materialize, prepare
from .ranks import positioned

#: Turns of a conversation that are searched at once.
SEGMENT = 128
#: What edits cost, and what a truncated turn costs that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Long conversations that are broadcast by id; beyond that, each meets its turns in SALT tasks.
BROADCAST_ROWS, SALT = 200_000, 32
#: States by the role before: none, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (NONE, ASSISTANT)
SPACES = " \t\n\v\f\r"
Turn = tuple[str, bool, int]  # role's initial, whether it must go, what it costs to stay
Best = tuple[int, str]


def children(turns: list[Turn], at: int, state: int, wait: bool) -> Iterator[tuple[int, str, int, int]]:
    """(cost, letter, next turn, next state) of the edits at a node. wait: nothing is inserted after the last turn."""
    want = ASSISTANT if state == USER else USER
    if at < len(turns):
        initial, must_go, stay = turns[at]
        yield DELETE, "D", at + 1, state
        if not must_go:
            if initial == "ua"[want - USER]:
                yield KEEP + stay, "K", at + 1, want
            elif initial == "s" and state == NONE:
                yield KEEP + stay, "K", at + 1, SYSTEM
            yield REROLE + stay, "R", at + 1, want
    if at < len(turns) or not wait:
        yield INSERT, "I", at, want


def relaxed(turns: list[Turn]) -> list[list[int]]:
    """A lower bound of what the turns from each on cost, by state: any end will do, in the middle of an exchange too."""
    out = [[0] * 4]
    for at in range(len(turns) - 1, -1, -1):
        row = [min(c + out[-1][s] for c, _, i, s in children(turns, at, state, False) if i > at) for state in STATES]
        # an insertion leads to a state whose row is known by now but for insertions of its own, which never pay
        out.append([min(row[s], INSERT + row[ASSISTANT if s == USER else USER]) for s in STATES])
    return out[::-1]


def search(turns: list[Turn], state: int = NONE, goals: tuple[int, ...] = ENDS, wait: bool = False, bound: list[list[int]] | None = None) -> Best | None:
    """The least (cost, audit) from state to one of goals after all turns; null if there is no way."""
    n = len(turns)
    bound = [row[:] for row in bound] if bound else relaxed(turns)
    best: Best | None = None
    reached: dict[tuple[int, int], Best] = {}
    # a node is met twice: on the way in, and (cost below 0) when all below it has been searched
    stack: list[tuple[int, int, int, str]] = [(0, 0, state, "")]
    while stack:
        cost, at, now, audit = stack.pop()
        if cost < 0:
            # what the rest costs at least, now that the nodes below have been searched
            rest = min((c + bound[i][s] for c, _, i, s in children(turns, at, now, wait)), default=1 << 40)
            if not (at == n and now in goals):
                bound[at][now] = max(bound[at][now], rest)
            continue
        if best and (cost + bound[at][now], audit) > (best[0], best[1][: len(audit)]):
            continue
        node = (at, now)
        if node in reached and reached[node] <= (cost, audit):
            continue
        reached[node] = (cost, audit)
        if at == n and now in goals and (best is None or (cost, audit) < best):
            best = (cost, audit)
        stack.append((-1, at, now, ""))
        # the most promising child is taken first; of equal ones, the least letter
        ahead = sorted(((c + bound[i][s], letter, c, i, s) for c, letter, i, s in children(turns, at, now, wait)), reverse=True)
        stack += [(cost + c, i, s, audit + letter) for _, letter, c, i, s in ahead]
    return best


def step(letter: str, initial: str, state: int) -> int:
    """The state after an edit."""
    if letter == "D":
        return state
    if letter == "K" and initial == "s":
        return SYSTEM
    return ASSISTANT if state == USER else USER


def repaired(turns: list[tuple[str, str]], audit: str, state: int = NONE) -> list[tuple[str, str]]:
    """(role, text) of the turns after the edits; state: what stands before them."""
    out, left = [], iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        state = step(letter, role[:1], state)
        if letter != "D":
            out.append((role if letter == "K" else "user" if state == USER else "assistant", text))
    return out


def faults(turns: list[tuple[str, str]], first: list[bool]) -> list[str]:
    """The first fault of each turn, or ''. first: whether no earlier turn has its role and text."""
    out = []
    for (_, text), new in zip(turns, first, strict=True):
        bare = text.rstrip(SPACES)
        out.append("blank" if not bare else "duplicate" if not new else "" if bare[-1] in ".!?" else "truncated")
    return out


def searched(turns: list[tuple[str, str]], wrong: list[str]) -> list[Turn]:
    return [(role[:1], f in ("blank", "duplicate"), TRUNCATED * (f == "truncated")) for (role, _), f in zip(turns, wrong, strict=True)]


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def joined(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


def digest(turns: list[tuple[str, str]]) -> str:
    return hashlib.sha256(joined(turns).encode()).hexdigest()


def whole(rows: list[dict]) -> dict:
    """A conversation's digests from its turns, in any order."""
    rows = sorted((r for r in rows if not r["gone"]), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"].encode(), r["text"].encode()))
    turns = [(r["role"], r["text"]) for r in rows]
    seen: set[tuple[str, str]] = set()
    wrong = faults(turns, [not (t in seen or seen.add(t)) for t in turns])
    cost, audit = search(searched(turns, wrong))
    known = {r["turn"] for r in rows} - {None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    counts = {f: wrong.count(f) for f in ("blank", "duplicate", "truncated")}
    return counts | {"gaps": (gaps + (1 << 63)) % (1 << 64) - (1 << 63), "illegal": illegal([t[0][:1] for t in turns]), "cost": cost, "audit": audit, "repaired_sha256": digest(repaired(turns, audit))}


def struct(longs: tuple[str, ...], *more: tuple[str, DataType]) -> StructType:
    return StructType([*(StructField(n, LongType()) for n in longs), *(StructField(n, t) for n, t in more)])


STRING = StringType()
COUNTS = ("blank", "duplicate", "truncated", "illegal")
TOTAL = struct((*COUNTS, "gaps", "cost"), ("audit", STRING))
DIGEST = struct((*COUNTS, "gaps", "cost"), ("audit", STRING), ("repaired_sha256", STRING))
LINES = ArrayType(struct((), ("role", STRING), ("text", STRING)))
WAY = struct(("cost",), ("state", IntegerType()), ("goal", IntegerType()), ("audit", STRING))
WAYS = struct((*COUNTS, "least", "most", "known"), ("first", STRING), ("last", STRING), ("ways", ArrayType(WAY)))
CHOSEN = struct(("segment",), ("group", STRING), ("state", IntegerType()), ("piece", STRING), ("total", TOTAL))


@F.arrow_udf(DIGEST)
def whole_of(lists: pa.Array) -> pa.Array:
    return pa.array([whole(rows) for rows in lists.to_pylist()], to_arrow_type(DIGEST))


def lines_of(rows: list[dict]) -> list[dict]:
    """The repaired turns of a whole conversation."""
    rows = sorted((r for r in rows if not r["gone"]), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"].encode(), r["text"].encode()))
    turns = [(r["role"], r["text"]) for r in rows]
    return [{"role": r, "text": t} for r, t in repaired(turns, whole(rows)["audit"])]


def segment_ways(turns: list[dict], firsts: list[int], last: bool) -> dict:
    """The counts of a segment, and its cheapest repair from each state to each."""
    pairs = [(t["role"], t["text"]) for t in turns]
    new = set(firsts)
    wrong = faults(pairs, [t["pos"] in new for t in turns])
    rows = searched(pairs, wrong)
    bound = relaxed(rows)
    ways = [(s, g, search(rows, s, (g,), not last, bound)) for s in STATES for g in (ENDS if last else STATES)]
    known = [t["turn"] for t in turns if t["turn"] is not None]
    out = {f: wrong.count(f) for f in ("blank", "duplicate", "truncated")} | {"illegal": illegal([r[0][:1] for r in pairs])}
    out |= {"first": pairs[0][0][:1], "last": pairs[-1][0][:1], "least": min(known, default=None), "most": max(known, default=None), "known": len(set(known))}
    return out | {"ways": [{"state": s, "goal": g, "cost": w[0], "audit": w[1]} for s, g, w in ways if w]}


@F.arrow_udf(WAYS)
def ways_of(lists: pa.Array, firsts: pa.Array, last: pa.Array) -> pa.Array:
    return pa.array([segment_ways(t, f or [], e) for t, f, e in zip(lists.to_pylist(), firsts.to_pylist(), last.to_pylist(), strict=True)], to_arrow_type(WAYS))


@F.arrow_udf(STRING)
def piece_of(lists: pa.Array, audits: pa.Array, states: pa.Array) -> pa.Array:
    """A segment's repaired lines as one text; null if there are none."""
    out = []
    for turns, audit, state in zip(lists.to_pylist(), audits.to_pylist(), states.to_pylist(), strict=True):
        kept = repaired([(t["role"], t["text"]) for t in turns], audit, state)
        out.append(joined(kept) if kept else None)
    return pa.array(out, pa.string())


class Chain:
    """A long conversation's segments, one after another: for each state the least (cost, audit) so far, and where it came from."""

    def __init__(self, group: str):
        self.group, self.at, self.back = group, {NONE: (0, "")}, []
        self.counts, self.edge, self.span, self.most = dict.fromkeys(COUNTS, 0), None, [], None
        self.known = 0

    def add(self, w: dict) -> None:
        best: dict[int, tuple[int, str, int, str]] = {}
        for x in w["ways"]:
            if x["state"] in self.at:
                cost, audit = self.at[x["state"]]
                new = (cost + x["cost"], audit + x["audit"], x["state"], x["audit"])
                if x["goal"] not in best or new[:2] < best[x["goal"]][:2]:
                    best[x["goal"]] = new
        self.at = {g: b[:2] for g, b in best.items()}
        self.back.append({g: b[2:] for g, b in best.items()})
        for c in COUNTS:
            self.counts[c] += w[c]
        if self.edge is not None:
            self.counts["illegal"] += illegal([self.edge, w["first"]])
        self.edge = w["last"]
        if w["known"]:
            self.known += w["known"] - (self.span[1:] == [w["least"]])
            self.span = [self.span[0] if self.span else w["least"], w["most"]]

    def rows(self) -> Iterator[tuple]:
        """(group, segment, state before, audit) of each segment; the totals stand in the last one's row."""
        goal = min(self.at, key=self.at.get)
        gaps = self.span[1] - self.span[0] + 1 - self.known if self.span else 0
        total = self.counts | {"gaps": (gaps + (1 << 63)) % (1 << 64) - (1 << 63), "cost": self.at[goal][0], "audit": self.at[goal][1]}
        for k in range(len(self.back) - 1, -1, -1):
            state, piece = self.back[k][goal]
            yield self.group, k, state, piece, total
            goal, total = state, None


def chained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (group, segment); of a conversation only its searched ways are kept, until it ends."""
    now = None
    columns = ["group", "segment", "state", "piece", "total"]

    def rows(c: Chain) -> pd.DataFrame:
        return pd.DataFrame(c.rows(), columns=columns)[CHOSEN.names]

    for frame in frames:
        for group, w in zip(frame["group"], frame["found"], strict=True):
            if now is None or now.group != group:
                if now:
                    yield rows(now)
                now = Chain(group)
            now.add(w)
    if now:
        yield rows(now)


def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each group's pieces, read in order and not kept."""
    now, made, some, out = None, None, False, []
    for frame in frames:
        for group, piece in zip(frame["group"], frame["piece"], strict=True):
            if group != now:
                if made:
                    out.append((now, made.hexdigest()))
                now, made, some = group, hashlib.sha256(), False
            if piece is not None:
                made.update((b"\n" if some else b"") + piece.encode())
                some = True
        yield pd.DataFrame(out, columns=["group", "repaired_sha256"])
        out = []
    if made:
        yield pd.DataFrame([(now, made.hexdigest())], columns=["group", "repaired_sha256"])


def turns_of(conversations: DataFrame) -> DataFrame:
    """Turns as they are repaired: a null role or text is one space; group stands for the conversation (null ones are one)."""
    return conversations.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("group"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        F.lit(False).alias("gone"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """turns_of conversations, one in twenty each dropped (marked gone), emptied, without its stops, repeated, or given the role user, by the CRC-32
    of `conv_id:turn` (a null is one space)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns_of(conversations).withColumn("chance", F.crc32(key) % 20)
    return rows.select(
        "group",
        "conv_id",
        "turn",
        F.when(F.col("chance") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("chance") == 1, F.lit("")).when(F.col("chance") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("chance") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("chance") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The turns of conversations of up to SEGMENT turns, and of the others (null if there are none)."""
    long_ = materialize(rows.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > SEGMENT).select("group"), "long")
    some = long_.limit(BROADCAST_ROWS + 1).count()
    if not some:
        return rows, None
    if some <= BROADCAST_ROWS:
        return rows.join(F.broadcast(long_), "group", "left_anti"), rows.join(F.broadcast(long_), "group", "left_semi")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("turn", "text"), F.lit(SALT)).cast("int"))
    each = long_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(each, ["group", "salt"], "left_anti").drop("salt"), salted.join(each, ["group", "salt"], "left_semi").drop("salt")


def gathered(rows: DataFrame) -> DataFrame:
    """Conversations of at most SEGMENT turns as arrays."""
    return rows.groupBy("group").agg(F.first("conv_id").alias("conv_id"), F.collect_list(F.struct("turn", "role", "text", "gone")).alias("turns"))


def segmented(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of long conversations (group, segment, turns), and what is chosen for each (group, segment, state, piece, total)."""
    live = materialize(rows.where("not gone").withColumn("row", F.monotonically_increasing_id()), "turns")
    placed = positioned(live, "group", ["turn", "role", "text", "row"])
    placed = materialize(placed.withColumn("segment", F.floor(F.col("pos") / SEGMENT).cast("long")), "placed")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    firsts = placed.groupBy("group", said.alias("said")).agg(F.min("pos").alias("pos")).groupBy("group", F.floor(F.col("pos") / SEGMENT).cast("long").alias("segment")).agg(F.collect_list("pos").alias("firsts"))
    parts = materialize(placed.groupBy("group", "segment").agg(F.max("width").alias("width"), F.array_sort(F.collect_list(F.struct("pos", "turn", "role", "text"))).alias("turns")), "segments")
    last = F.col("segment") == F.floor((F.col("width") - 1) / SEGMENT)
    found = materialize(parts.join(firsts, ["group", "segment"], "left").select("group", "segment", ways_of("turns", "firsts", last).alias("found")), "ways")
    chosen = found.repartition("group").sortWithinPartitions("group", "segment").mapInPandas(chained, CHOSEN)
    return parts, materialize(chosen, "chosen")


def repair(rows: DataFrame) -> DataFrame:
    """Of each conversation of rows (turns_of or damaged): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Turns are taken by turn (nulls first), then role and text. A null role or text is one space, thus a role that can't stay and a blank text; a null
    conv_id is a conversation of its own. Rows that repeat a turn are duplicates but for the first. A conversation of which all turns are gone has zeros,
    an empty audit and the hash of an empty text. Texts of any length are read whole. Other columns are left out.
    """
    prepare(rows.sparkSession)
    own = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    short, long_ = parted(rows)
    done = gathered(short).select("conv_id", whole_of("turns").alias("x")).select("conv_id", "x.*").select(own)
    if long_ is None:
        return done
    parts, chosen = segmented(long_)
    pieces = parts.join(chosen, ["group", "segment"]).select("group", "segment", piece_of("turns", "piece", "state").alias("piece"))
    digests = pieces.repartition("group").sortWithinPartitions("group", "segment").mapInPandas(hashed, "group string, repaired_sha256 string")
    totals = chosen.where("total is not null").select("group", "total.*").join(digests, "group")
    out = long_.select("group", "conv_id").distinct().join(totals, "group", "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in own[1:7]]
    return done.unionByName(out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(digest([]))).alias("repaired_sha256")))


@F.arrow_udf(LINES)
def lines_each(lists: pa.Array) -> pa.Array:
    return pa.array([lines_of(rows) for rows in lists.to_pylist()], to_arrow_type(LINES))


@F.arrow_udf(LINES)
def lines_part(lists: pa.Array, audits: pa.Array, states: pa.Array) -> pa.Array:
    out = []
    for turns, audit, state in zip(lists.to_pylist(), audits.to_pylist(), states.to_pylist(), strict=True):
        out.append([{"role": r, "text": t} for r, t in repaired([(t["role"], t["text"]) for t in turns], audit, state)])
    return pa.array(out, to_arrow_type(LINES))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, segment, place (within the segment), role, text. Cases: see repair. A conversation of which
    nothing is left has no rows."""
    prepare(rows.sparkSession)
    short, long_ = parted(rows)
    lines = gathered(short).select("conv_id", F.lit(0).cast("long").alias("segment"), lines_each("turns").alias("lines"))
    if long_ is not None:
        parts, chosen = segmented(long_)
        ids = F.when(F.col("group") != "", F.substr("group", F.lit(2)).cast("long"))
        lines = lines.unionByName(parts.join(chosen, ["group", "segment"]).select(ids.alias("conv_id"), "segment", lines_part("turns", "piece", "state").alias("lines")))
    return lines.select("conv_id", "segment", F.posexplode("lines").alias("place", "x")).select("conv_id", "segment", "place", "x.*")
