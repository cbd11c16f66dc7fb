"""Repair of conversation structure: the cheapest edits that make roles alternate, found with checkpoints.

Rows of a conversation stand by turn (nulls first; rows of one turn by role, text and arrival). An output is legal if the
initials of its roles are nothing, or user / assistant pairs after at most one system row. Three prefixes of it matter for what may
follow, and the empty one, so a row is a step between four STATES, and a conversation is a shortest path.

The backward pass gives, for each place, the vector of costs to the end from each state. Only one vector in about
sqrt(n) is stored; walking forward, a block's vectors are worked out again from the checkpoint at its end, and of the
edits that are on a cheapest path (tight ones) the ASCII-least letter is taken. A letter leads to one state only, so the
letters are the least string of all cheapest ones, and tell the repaired rows (`outputs`).

Ordinary conversations are walked in one streaming pass over partitions sorted by conversation. One above HOT_ROWS rows
or HOT_BYTES bytes is laid out in blocks over many tasks: each block gives the matrix of costs from state to state, the
matrices of a conversation are folded from the end into checkpoints, blocks are walked from every state, folded from
the start to the states they really begin in, and walked again. What is left for one task is what the result itself
demands, one string of edits and one digest of the repaired rows, which is fed row by row.

Edge cases: a null conv_id is a conversation of its own; a null turn sorts first and reads as a space in the checksum; a null
role or text is one space; a role with another first letter, or an empty one, can't be kept; conversations that lose all
rows, or have none left to keep, have an empty digest; repeated rows are duplicates; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerproof.llm.ship import ship
from ledgerproof.operators.sequence import BLOCK, Ordered, Sort, blocked, plain
from ledgerproof.session import broadcast_if_small, materialise

# A conversation with more rows, or more bytes of text, is spread over blocks.
HOT_ROWS, HOT_BYTES, BLOCK_ROWS = 20_000, 64_000_000, 10_000

# The checksum's divisor and what its remainders do to a row, costs, and the white space of texts.
DIVISOR, DROP, EMPTY, UNMARK, REPEAT, USER = 20, 0, 1, 2, 3, 4
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INK = r"[^\x20\x09-\x0D]"
LEGAL_PAIRS = ("su", "ua", "au")

# -- the automaton. A row's code is its fault and its initial: (blank or duplicate, truncated) x (s, u, a, other).

STATES = range(4)
EMPTY_STATE, AFTER_S, AFTER_U, AFTER_A = STATES
FINAL = (EMPTY_STATE, AFTER_A)
FAR = 1 << 60
# The role that an inserted or re-roled row has after each state, and the state that it leads to.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
INITIALS = "sua"
OTHER = 3


def kept(state: int, initial: int) -> int | None:
    """The state after keeping a row with this initial."""
    if initial == 0:
        return AFTER_S if state == EMPTY_STATE else None
    return NEXT[state] if initial < OTHER and INITIALS[initial] == NEXT_ROLE[state][0] else None


def steps(code: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of a row with this code: (letter, cost, next state), letters in ASCII order."""
    gone, truncated, initial = code >> 3, code >> 2 & 1, code & 3
    out = []
    for state in STATES:
        own = [("D", DELETE, state)]
        if not gone:
            if (to := kept(state, initial)) is not None:
                own.append(("K", TRUNCATED * truncated, to))
            own.append(("R", REROLE + TRUNCATED * truncated, NEXT[state]))
        out.append(own)
    return out


STEPS = [steps(code) for code in range(16)]
END = [0 if s in FINAL else FAR for s in STATES]


def inserted(costs: list[int]) -> list[int]:
    """Costs with any number of insertions before: three states at most are passed."""
    for _ in STATES:
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return costs


def back(code: int, after: list[int]) -> list[int]:
    """Costs before a row, without and with insertions, from those after it."""
    return inserted([min(cost + after[to] for _, cost, to in own) for own in STEPS[code]])


def vectors(codes: bytes, end: list[int]) -> list[list[int]]:
    """Costs before each row of a block, and after the last; `end` has insertions at its place worked in."""
    out = [end]
    for code in reversed(codes):
        out.append(back(code, out[-1]))
    return out[::-1]


def walk(codes: bytes, end: list[int], state: int) -> tuple[str, int]:
    """Letters of a block from a state, and the state it is left in; insertions after the last row are the next block's."""
    before, letters = vectors(codes, end), []
    for i, code in enumerate(codes):
        here = before[i]
        while True:
            tight = [x for x in STEPS[code][state] if x[1] + before[i + 1][x[2]] == here[state]]
            insert = INSERT + here[NEXT[state]] == here[state]
            least = min(tight, default=None)
            if insert and (least is None or least[0] > "I"):
                letters.append("I")
                state = NEXT[state]
                continue
            letters.append(least[0])
            state = least[2]
            break
    return "".join(letters), state


def closing(state: int) -> tuple[str, int]:
    """Insertions after the last row."""
    letters = ""
    while state not in FINAL:
        letters, state = letters + "I", NEXT[state]
    return letters, state


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a whole conversation, with about sqrt(n) stored vectors."""
    size = max(1, math.isqrt(len(codes)))
    starts = range(0, len(codes), size)
    checkpoints = [inserted(END)]
    for start in reversed(starts):
        costs = checkpoints[-1]
        for code in reversed(codes[start : start + size]):
            costs = back(code, costs)
        checkpoints.append(costs)
    cost, state, letters = checkpoints.pop()[EMPTY_STATE], EMPTY_STATE, []
    for start in starts:
        more, state = walk(codes[start : start + size], checkpoints.pop(), state)
        letters.append(more)
    letters.append(closing(state)[0])
    return cost, "".join(letters)


def outputs(letters: str, rows: Iterator[tuple[str, str]], state: int = EMPTY_STATE) -> Iterator[str]:
    """The repaired `role:text` lines; rows are (role, text) as they were."""
    for letter in letters:
        if letter == "I":
            yield f"{NEXT_ROLE[state]}:"
            state = NEXT[state]
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        if letter == "R":
            role = NEXT_ROLE[state]
        yield f"{role}:{text}"
        state = AFTER_S if letter == "K" and role[0] == "s" else NEXT[state]


class Digest:
    """SHA-256 of lines joined by line feeds, fed one by one."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, line: str) -> None:
        self.sha.update(("\n" if self.any else "").encode() + line.encode("utf-8", "surrogatepass"))
        self.any = True

    def hex(self) -> str:
        return self.sha.hexdigest()


# -- rows


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, at (arrival, unique) of the rows after damage."""
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    k = F.crc32(name) % DIVISOR
    text = F.when(k == EMPTY, "").when(k == UNMARK, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("__k", k).filter(F.col("__k") != DROP).select("conv_id", "turn", F.when(k == USER, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "__k")
    rows = rows.withColumn("__arrival", F.monotonically_increasing_id())
    # A repeated row is two rows with the same turn, one after the other.
    twice = F.explode(F.when(F.col("__k") == REPEAT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", "__arrival", twice.alias("__copy")).select("conv_id", "turn", "role", "text", (2 * F.col("__arrival") + F.col("__copy")).alias("at"))


ORDER = (Sort("turn", nulls_first=True), Sort("role"), Sort("text"), Sort("at"))
KEY = "__conv"


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def with_faults(rows: Ordered) -> Ordered:
    """`code` of each row, and `illegal`, whether its initial may not follow that of the row before."""
    df = rows.df.withColumn("words", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    if rows.blocks:
        first = df.groupBy(*rows.keys, "words").agg(F.min(rows.rank).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        df = df.join(first, [*rows.keys, "words"], "left").withColumn("again", F.coalesce(rows.rank > F.col("first"), F.lit(False))).drop("first")
    else:
        df = df.withColumn("again", F.row_number().over(Window.partitionBy(*rows.keys, "words").orderBy(*[k.order() for k in rows.order])) > 1)
    seen = rows.over(df.drop("words")).lag(initial(F.col("role")), "before")
    blank = ~F.col("text").rlike(INK)
    # The last character that isn't white space.
    open_end = ~F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     ")).rlike(r"[.!?]\z")
    fault = F.when(blank, 1).when(F.col("again"), 2).when(open_end, 3).otherwise(0)
    letter = initial(F.col("role"))
    letter = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(OTHER)
    pair = F.concat("before", initial(F.col("role")))
    df = seen.df.withColumn("fault", fault).withColumn("illegal", F.col("before").isNotNull() & ~pair.isin(*LEGAL_PAIRS)).drop("before", "again")
    code = 8 * F.col("fault").isin(1, 2).cast("int") + 4 * (F.col("fault") == 3).cast("int") + letter
    return rows.over(df.withColumn("code", code.cast("tinyint")))


def counts(rows: DataFrame) -> DataFrame:
    """gaps, blank, duplicate, truncated, illegal of every conversation."""
    turns = rows.groupBy(KEY, "turn").agg(
        F.count_if(F.col("fault") == 1).alias("blank"), F.count_if(F.col("fault") == 2).alias("duplicate"), F.count_if(F.col("fault") == 3).alias("truncated"), F.count_if("illegal").alias("illegal")
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy(KEY).agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])


REPAIRED = f"{KEY} string, cost long, audit string, repaired_sha256 string"


def repaired_plain(rows: DataFrame) -> DataFrame:
    """REPAIRED of conversations that fit a task's memory, one after the other."""
    laid = rows.select(KEY, "code", "role", "text", *[k.expr for k in ORDER if k.expr not in ("role", "text")]).repartition(KEY)
    laid = laid.sortWithinPartitions(KEY, *[k.order() for k in ORDER]).select(KEY, "code", "role", "text")

    def done(key: str, codes: bytearray, lines: list[tuple[str, str]]) -> tuple:
        cost, letters = repair(bytes(codes))
        digest = Digest()
        for line in outputs(letters, iter(lines)):
            digest.add(line)
        return key, cost, letters, digest.hex()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codes, lines = None, bytearray(), []
        for batch in batches:
            out = []
            for k, code, role, text in zip(*(batch.column(c).to_pylist() for c in (KEY, "code", "role", "text")), strict=True):
                if k != key:
                    if lines:
                        out.append(done(key, codes, lines))
                    key, codes, lines = k, bytearray(), []
                codes.append(code)
                lines.append((role, text))
            yield as_batch(out)
        if lines:
            yield as_batch([done(key, codes, lines)])

    return laid.mapInArrow(run, REPAIRED)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [KEY, "cost", "audit", "repaired_sha256"])


# -- hot conversations


def codes_of(table: pa.Table) -> bytes:
    order = pa.compute.sort_indices(table, [("rn", "ascending")])
    return table["code"].take(order).to_numpy().astype("uint8").tobytes()


def matrix_of(key: tuple, table: pa.Table) -> pa.Table:
    """Cost of getting through a block from each state to each (insertions before its rows, not after)."""
    codes = codes_of(table)
    costs = []
    for to in STATES:
        vector = [0 if s == to else FAR for s in STATES]
        for code in reversed(codes):
            vector = back(code, vector)
        costs.append(vector)
    return pa.table({KEY: pa.array([key[0].as_py()], pa.string()), BLOCK: pa.array([key[1].as_py()], pa.int32()), "costs": pa.array([[costs[to][s] for s in STATES for to in STATES]], pa.list_(pa.int64()))})


def by_block(table: pa.Table) -> pa.Table:
    return table.sort_by(BLOCK)


def checkpoints_of(key: tuple, table: pa.Table) -> pa.Table:
    """Costs at the end of each block of a conversation, and the cost of all."""
    table = by_block(table)
    vector, ends = inserted(END), []
    for costs in reversed(table["costs"].to_pylist()):
        ends.append(vector)
        vector = [min(costs[4 * s + to] + vector[to] for to in STATES) for s in STATES]
    n = table.num_rows
    return pa.table({KEY: table[KEY], BLOCK: table[BLOCK], "ends": pa.array(ends[::-1], pa.list_(pa.int64())), "cost": pa.array([vector[EMPTY_STATE]] * n, pa.int64())})


def exits_of(key: tuple, table: pa.Table) -> pa.Table:
    """The states that a block is left in, by the one it is entered in (one that can't occur leads anywhere)."""
    codes, end = codes_of(table), table["ends"][0].as_py()
    exits = [walk(codes, end, s)[1] for s in STATES]
    return pa.table({KEY: pa.array([key[0].as_py()], pa.string()), BLOCK: pa.array([key[1].as_py()], pa.int32()), "exits": pa.array([exits], pa.list_(pa.int64()))})


def entries_of(key: tuple, table: pa.Table) -> pa.Table:
    table = by_block(table)
    state, entries = EMPTY_STATE, []
    for exits in table["exits"].to_pylist():
        entries.append(state)
        state = exits[state]
    last = [False] * (table.num_rows - 1) + [True]
    return pa.table({KEY: table[KEY], BLOCK: table[BLOCK], "entry": pa.array(entries, pa.int64()), "last": pa.array(last)})


def letters_of(key: tuple, table: pa.Table) -> pa.Table:
    letters, state = walk(codes_of(table), table["ends"][0].as_py(), table["entry"][0].as_py())
    letters += closing(state)[0] if table["last"][0].as_py() else ""
    return pa.table({KEY: pa.array([key[0].as_py()], pa.string()), BLOCK: pa.array([key[1].as_py()], pa.int32()), "letters": pa.array([letters], pa.string())})


def repaired_blocked(rows: Ordered) -> DataFrame:
    """REPAIRED of conversations laid out in blocks."""
    coded = rows.df.select(*rows.part, F.row_number().over(rows.window).alias("rn"), "code")
    at = f"{KEY} string, {BLOCK} int"
    matrices = materialise(coded.groupBy(*rows.part).applyInArrow(matrix_of, f"{at}, costs array<long>"), "conv_matrices")
    most = 2 * rows.blocks
    ends = materialise(matrices.groupBy(KEY).applyInArrow(checkpoints_of, f"{at}, ends array<long>, cost long"), "conv_checkpoints")
    coded = coded.join(broadcast_if_small(ends.drop("cost"), most), rows.part)
    exits = materialise(coded.groupBy(*rows.part).applyInArrow(exits_of, f"{at}, exits array<long>"), "conv_exits")
    entries = materialise(exits.groupBy(KEY).applyInArrow(entries_of, f"{at}, entry long, last boolean"), "conv_entries")
    letters = coded.join(broadcast_if_small(entries, most), rows.part).groupBy(*rows.part).applyInArrow(letters_of, f"{at}, letters string")
    letters = materialise(letters.join(entries, rows.part), "conv_letters")

    # The digest takes the rows of a conversation one after the other.
    laid = rows.df.select(*rows.part, "role", "text", F.row_number().over(rows.window).alias("rn"))
    laid = laid.join(broadcast_if_small(letters.select(*rows.part, "letters", "entry"), most), rows.part)
    laid = laid.withColumn("letters", F.when(F.col("rn") == 1, F.col("letters"))).repartition(KEY).sortWithinPartitions(KEY, BLOCK, "rn")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, walker, held = None, Digest(), None, []
        for batch in batches:
            out = []
            for k, role, text, own, entry in zip(*(batch.column(c).to_pylist() for c in (KEY, "role", "text", "letters", "entry")), strict=True):
                if own is not None and held:
                    for line in outputs(walker[0], iter(held), walker[1]):
                        digest.add(line)
                    held = []
                if k != key:
                    if key is not None:
                        out.append((key, digest.hex()))
                    key, digest = k, Digest()
                if own is not None:
                    walker = (own, entry)
                held.append((role, text))
            yield pa.record_batch([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], [KEY, "repaired_sha256"])
        if key is not None:
            for line in outputs(walker[0], iter(held), walker[1]):
                digest.add(line)
            yield pa.record_batch([pa.array([x], pa.string()) for x in (key, digest.hex())], [KEY, "repaired_sha256"])

    hashes = laid.mapInArrow(digests, f"{KEY} string, repaired_sha256 string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(BLOCK, "letters"))), lambda x: x["letters"]), "")
    audits = letters.groupBy(KEY).agg(joined.alias("audit"))
    cost = ends.groupBy(KEY).agg(F.max("cost").alias("cost"))
    return cost.join(audits, KEY).join(hashes, KEY).select(KEY, "cost", "audit", "repaired_sha256")


# -- all together


def repaired(conversations: DataFrame, hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    ship(conversations.sparkSession)
    # One string that also stands for a null id.
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")).alias(KEY)
    rows = materialise(damaged(conversations).select(key, "turn", "role", "text", "at"), "conv_damaged")
    sizes = rows.groupBy(KEY).agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    hot = materialise(sizes.filter((F.col("n") > hot_rows) | (F.col("bytes") > hot_bytes)), "conv_hot")
    n_hot, n_rows, n_bytes = hot.agg(F.count("*"), F.sum("n"), F.sum("bytes")).first()
    known = broadcast_if_small(hot.select(KEY), n_hot)
    cold = with_faults(plain(rows.join(known, KEY, "left_anti") if n_hot else rows, (KEY,), ORDER)).df
    cold = materialise(cold.select(KEY, "turn", "role", "text", "at", "code", "fault", "illegal"), "conv_rows")
    found, counted = repaired_plain(cold), counts(cold)
    if n_hot:
        # Blocks of at most about block_rows rows and as many bytes as that share of hot_bytes.
        wanted = max(n_rows, -(-n_bytes * hot_rows // hot_bytes))
        laid = with_faults(blocked(rows.join(known, KEY, "left_semi"), (KEY,), ORDER, wanted, block_rows))
        laid = laid.over(materialise(laid.df.select(*laid.part, "turn", "role", "text", "at", "code", "fault", "illegal"), "conv_blocks"))
        found, counted = found.unionByName(repaired_blocked(laid)), counted.unionByName(counts(laid.df))
    out = conversations.select("conv_id").distinct().withColumn(KEY, key)
    out = out.join(counted, KEY, "left").join(found, KEY, "left")
    none = hashlib.sha256().hexdigest()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
