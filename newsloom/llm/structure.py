"""Repair of the structure of conversations by a grammar-compressed dynamic programme.

The role initials of a conversation should read ``(s?(ua)+)?``.  Rows may be kept, given
the other role, deleted, and empty rows inserted; the cheapest edits are found over the
four states of that pattern.

*  A row is one of a few symbols (its initial and its fault).  The edits a symbol allows
   are a matrix over the states: least cost and, as a rope, the audit of the edits.
   Matrices of neighbours multiply by minimum and sum; equal costs go to the audit that
   is least in ASCII.  (Two audits of one cost between the same states are never prefixes
   of each other: they would differ by inserts alone, which cost.)
*  The different symbol sequences of many conversations are compressed together by
   Re-Pair: the most frequent pair of neighbours becomes a rule, again and again.  A rule
   has one matrix, the product of its two sides; rules are evaluated bottom-up, once, for
   all conversations that use them.
*  Conversations are laid out by a range sort of narrow rows and cut where its slices
   end.  A conversation within a slice is solved there.  The parts of one that crosses
   slices are matrices with ropes that share their rules, and are multiplied afterwards,
   so the size of a conversation is bounded by no task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import WORD, written

#: States of the pattern: nothing yet, after the system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = 4, (START, ASSISTANT)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER,
         (USER, "a"): ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Symbols: initial (s, u, a, any other) with a whole or truncated text, and rows that must go.
INITIALS = "suao"
GONE = 2 * len(INITIALS)
LEGAL = ("su", "ua", "au")
#: Symbols compressed together in a task.
BATCH = 1 << 18
SHORT = 64
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79


# --------------------------------------------------------------------- ropes

class Rope:
    """A string as a tree that shares its parts; equal parts are told by size and hash."""

    __slots__ = ("text", "left", "right", "size", "code")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.size = left.size + right.size
            self.code = (left.code * pow(BASE, right.size, PRIME) + right.code) % PRIME
        else:
            self.size, self.code = len(text), 0
            for c in text:
                self.code = (self.code * BASE + ord(c)) % PRIME

    def __reduce__(self):
        return Rope, (self.text, self.left, self.right)

    def __add__(self, other: Rope) -> Rope:
        if not other.size:
            return self
        if not self.size:
            return other
        if self.size + other.size <= SHORT:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            r = stack.pop()
            if r.text is None:
                stack += [r.right, r.left]
            else:
                yield r.text

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        one, two = [self], [other]
        while one and two:
            a, b = one.pop(), two.pop()
            if a.size == b.size and a.code == b.code:
                continue
            if a.text is None and (b.text is not None or a.size >= b.size):
                one += [a.right, a.left]
                two.append(b)
            elif b.text is None:
                two += [b.right, b.left]
                one.append(a)
            else:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text < b.text
                if a.size > n:
                    one.append(Rope(a.text[n:]))
                if b.size > n:
                    two.append(Rope(b.text[n:]))
        return bool(two)


# ------------------------------------------------------------------ matrices

Matrix = dict[tuple[int, int], tuple[int, Rope]]


def better(out: Matrix, at: tuple[int, int], cost: int, rope: Rope) -> None:
    held = out.get(at)
    if held is None or cost < held[0] or (cost == held[0] and rope < held[1]):
        out[at] = (cost, rope)


def product(a: Matrix, b: Matrix) -> Matrix:
    """Least cost and audit from each state to each, first by ``a``, then by ``b``."""
    least: dict[tuple[int, int], list] = {}
    for (i, k), (x, _) in a.items():
        for j in range(STATES):
            if (k, j) in b:
                cost, held = x + b[k, j][0], least.get((i, j))
                if held is None or cost < held[0]:
                    least[i, j] = [cost, [k]]
                elif cost == held[0]:
                    held[1].append(k)
    out = {}
    for (i, j), (cost, through) in least.items():
        ropes = [a[i, k][1] + b[k, j][1] for k in through]
        best = ropes[0]
        for r in ropes[1:]:
            best = r if r < best else best
        out[i, j] = (cost, best)
    return out


def _inserts() -> Matrix:
    out: Matrix = {}
    for i in range(STATES):
        state, cost, rope = i, 0, Rope("")
        for _ in range(3):
            better(out, (i, state), cost, rope)
            state = STEPS[state, "a" if state == USER else "u"]
            cost, rope = cost + INSERT, rope + Rope("I")
    return out


INSERTS = _inserts()


def symbol_matrix(symbol: int) -> Matrix:
    """Inserts before a row, and the row kept, given a role, or deleted."""
    out: Matrix = {}
    for i in range(STATES):
        better(out, (i, i), DELETE, Rope("D"))
        if symbol == GONE:
            continue
        initial, cut = INITIALS[symbol // 2], symbol % 2 * TRUNCATED
        if (i, initial) in STEPS:
            better(out, (i, STEPS[i, initial]), KEEP + cut, Rope("K"))
        for role in ROLES:
            if (i, role) in STEPS:
                better(out, (i, STEPS[i, role]), REROLE + cut, Rope("R"))
    return product(INSERTS, out)


def folded(matrices: list[Matrix]) -> Matrix | None:
    """Product of all, in order, as a tree of little depth."""
    while len(matrices) > 1:
        matrices = [product(*matrices[i:i + 2]) if i + 1 < len(matrices) else matrices[i]
                    for i in range(0, len(matrices), 2)]
    return matrices[0] if matrices else None


def solved(matrix: Matrix | None) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if matrix is None:
        return 0, ""
    whole = product(matrix, INSERTS)
    cost, rope = min((whole[START, j] for j in ENDS if (START, j) in whole), key=lambda x: (x[0], str(x[1])))
    return cost, str(rope)


# ------------------------------------------------------------------- Re-Pair

def re_pair(sequences: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Rules, numbered from GONE + 1, and the sequences in terms of them.

    The most frequent pair of neighbours, the least of equal ones, becomes a rule until
    no pair stands twice.
    """
    sizes = np.array([len(s) for s in sequences], np.int64)
    text = np.full(int(sizes.sum()) + len(sequences), -1, np.int64)
    edge = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(text), bool)
    inside[edge] = False
    text[inside] = np.concatenate([*sequences, np.zeros(0, np.int64)])
    rules: list[tuple[int, int]] = []
    while len(text) > 1:
        left, right = text[:-1], text[1:]
        pairs = (left << 32 | right)[(left >= 0) & (right >= 0)]
        if not len(pairs):
            break
        codes, n = np.unique(pairs, return_counts=True)
        most = int(n.argmax())
        if n[most] < 2:
            break
        x, y = int(codes[most] >> 32), int(codes[most] & 0xFFFFFFFF)
        at = np.flatnonzero((left == x) & (right == y))
        if x == y:  # in a run of one symbol every other place is a pair
            first = np.append(True, np.diff(at) > 1)
            start = at[first][np.cumsum(first) - 1]
            at = at[(at - start) % 2 == 0]
        text = text.copy()
        text[at] = GONE + 1 + len(rules)
        text = np.delete(text, at + 1)
        if len(at) < 2:  # overlapping in every place but one: nothing is shared
            rules.append((x, y))
            break
        rules.append((x, y))
    cut = np.flatnonzero(text < 0)
    return rules, [text[a:b] for a, b in zip(np.append(0, cut[:-1] + 1), cut)] if len(cut) else []


def evaluated(sequences: list[np.ndarray]) -> list[Matrix | None]:
    """Matrix of each sequence; each rule is evaluated once, those below it first."""
    different: dict[bytes, int] = {}
    place = [different.setdefault(s.tobytes(), len(different)) for s in sequences]
    kept = [np.frombuffer(b, np.uint8).astype(np.int64) for b in different]
    rules, short = re_pair(kept)
    matrix = [symbol_matrix(s) for s in range(GONE + 1)]
    for x, y in rules:
        matrix.append(product(matrix[x], matrix[y]))
    found = [folded([matrix[s] for s in seq.tolist()]) for seq in short]
    return [found[p] for p in place]


# ---------------------------------------------------------------------- rows

def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with rows dropped, emptied, cut, repeated or given to
    the user, by a hash of ``conv_id:turn``.  Nulls read as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(
        blank("text"))
    times = F.when(way == 0, 0).when(way == 3, 2).otherwise(1)
    return rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.when(way == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("__again")).drop("__again")


def identity() -> Column:
    """Equal for equal role and text."""
    role = F.coalesce("role", F.lit(" "))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.coalesce("text", F.lit(" ")))))


def marked(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with their number n, initial and fault of the first of them.

    A text or role that stands in very many rows is counted where it lies before rows
    move; the first of them is found the same way.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    initial = F.substring(role, 1, 1)
    same = written(rows.select(
        "conv_id", "turn", identity().alias("same"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        (~F.regexp_like(text, F.lit(WORD))).alias("blank"),
        (~last.isin(".", "!", "?")).alias("open"),
    ).groupBy("conv_id", "turn", "same", "initial", "blank", "open").agg(F.count("*").alias("n")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = same.groupBy(F.col("conv_id").alias("c"), F.col("same").alias("s")).agg(
        F.min(order).alias("first"))
    joined = same.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")))
    again = ~order.eqNullSafe(F.col("first"))
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("open"), "truncated")
    return joined.select("conv_id", "turn", "same", "initial", "n", fault.alias("fault"))


def counted(rows: DataFrame) -> DataFrame:
    """gaps, blank, duplicate and truncated of each conversation of marked rows."""
    turns = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("n"))
              .otherwise(F.col("n") - 1)).alias("duplicate"),
        F.count_if(F.col("fault") == "truncated").alias("truncated"))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def slices(rows: DataFrame) -> DataFrame:
    """Marked rows in order of conversation and turn, as slices of even size."""
    order = ["conv_id", "turn", "same"]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return laid.select("conv_id", "initial", "fault", "n")


def parts(rows: DataFrame) -> DataFrame:
    """(conv_id, slice, whole, first, last, illegal, cost, audit, matrix) of each slice's conversations.

    The first and the last conversation of a slice may go on in others: they come as
    matrices, all others are solved.
    """
    spec = ("conv_id long, slice int, whole boolean, first string, last string, illegal long, "
            "cost long, audit string, matrix binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, done, edge = TaskContext.get().partitionId(), [], True
        current, held = None, []

        def close() -> tuple:
            codes, initials = (np.concatenate(x) for x in zip(*held))
            bad = ~np.isin(initials[:-1] * 4 + initials[1:], [
                INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in LEGAL])
            return current[0], codes, INITIALS[initials[0]], INITIALS[initials[-1]], int(bad.sum())

        def flush(conversations: list[tuple], open_ones: set[int]) -> pa.RecordBatch:
            out = []
            found = evaluated([c[1] for c in conversations])
            for i, ((conv, _, a, b, bad), m) in enumerate(zip(conversations, found)):
                if i in open_ones:
                    out.append((conv, here, False, a, b, bad, None, None, pickle.dumps(m)))
                else:
                    out.append((conv, here, True, a, b, bad, *solved(m), None))
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(),
                     pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)],
                [s.split()[0] for s in spec.split(", ")])

        for batch in batches:
            convs = batch.column(0).to_pylist()
            initial = np.array([INITIALS.index(x) for x in batch.column(1).to_pylist()], np.int64)
            fault = np.array([{"truncated": 1, None: 0}.get(x, 2) for x in batch.column(2).to_pylist()])
            times = batch.column(3).to_numpy()
            symbol = np.where(fault == 2, GONE, 2 * initial + fault).astype(np.uint8)
            cuts = [0, *[i for i in range(1, len(convs)) if convs[i] != convs[i - 1]], len(convs)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b == a:
                    continue
                if current is not None and current[0] != convs[a]:
                    done.append(close())
                    held = []
                    if sum(len(d[1]) for d in done) > BATCH:
                        yield flush(done, {0} if edge else set())
                        done, edge = [], False
                current = (convs[a],)
                # Of equal rows the first has the symbol, the others must go.
                codes = np.full(int(times[a:b].sum()), GONE, np.uint8)
                codes[np.cumsum(times[a:b]) - times[a:b]] = symbol[a:b]
                held.append((codes, np.repeat(initial[a:b], times[a:b])))
        if current is not None:
            done.append(close())
            yield flush(done, ({0} if edge else set()) | {len(done) - 1})

    return rows.mapInArrow(run, spec)


def merged_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """A conversation that came in several slices, or may have."""
    pdf = pdf.sort_values("slice")
    cost, audit = solved(folded([pickle.loads(m) for m in pdf["matrix"]]))
    seams = sum(a + b not in LEGAL for a, b in zip(pdf["last"].iloc[:-1], pdf["first"].iloc[1:]))
    conv = pdf["conv_id"].astype("Int64").iloc[:1].to_numpy(object, na_value=None)
    return pd.DataFrame({"conv_id": pd.Series(conv, dtype="Int64"),
                         "illegal": [int(pdf["illegal"].sum()) + seams], "cost": [cost], "audit": [audit]})


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit) of each conversation of marked rows."""
    found = written(parts(slices(rows)), "conversation-parts")
    cols = ["conv_id", "illegal", "cost", "audit"]
    merged = found.where("NOT whole").select(
        "conv_id", "slice", "first", "last", "illegal", "matrix").groupBy("conv_id").applyInPandas(
        merged_parts, "conv_id long, illegal long, cost long, audit string")
    return found.where("whole").select(*cols).unionByName(merged)


class Writer:
    """The repaired rows of one conversation, hashed as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines = audit, 0, START, 0
        self.sha = hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.sha.update(((("\n" if self.lines else "") + role + ":" + text)).encode("utf-8", "surrogatepass"))
        self.lines += 1
        self.state = STEPS.get((self.state, role[:1]), self.state)

    def due(self) -> str:
        return ROLES["a" if self.state == USER else "u"]

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.line(self.due(), "")

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.line(role if edit == "K" else self.due(), text)

    def done(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` (conv_id, FIGURES, audit) with the hash of the repaired conversation.

    The rows of a conversation pass through one task in order, the audit first, and are
    hashed one by one; nothing is held but the audit.  A hash of a whole conversation
    cannot be had from parts, so this one pass has no split.
    """
    heads = results.select("conv_id", F.lit(False).alias("is_row"), F.lit(None).cast("long").alias("turn"),
                           F.lit(None).cast("binary").alias("same"), F.lit(None).cast("string").alias("role"),
                           F.col("audit").alias("text"), *FIGURES)
    lines = rows.select("conv_id", F.lit(True).alias("is_row"), "turn", identity().alias("same"),
                        F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"),
                        *[F.lit(None).cast("long").alias(c) for c in FIGURES])
    stream = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions(
        "conv_id", "is_row", "turn", "same")
    spec = f"conv_id long, {', '.join(f'{c} long' for c in FIGURES)}, audit string, repaired_sha256 string"
    names = [s.split()[0] for s in spec.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, writer = None, None
        for batch in batches:
            out = []
            is_row, roles, texts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i, r in enumerate(is_row):
                if r:
                    writer.row(roles[i], texts[i])
                    continue
                if head is not None:
                    out.append((*head, writer.done()))
                head = (batch.column(0)[i].as_py(), *[
                    batch.column(4 + j)[i].as_py() for j in range(len(FIGURES))], texts[i])
                writer = Writer(texts[i])
            if out:
                yield as_batch(out)
        if head is not None:
            yield as_batch([(*head, writer.done())])

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * (1 + len(FIGURES)) + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)

    return stream.drop("turn", "same").mapInArrow(run, spec)


def repair(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the hash of the result.

    Columns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256.  Rows go by turn, nulls first; rows with one turn by a hash of role
    and text, equal ones together.  Null roles and texts read as one space; null conv_id
    is a conversation of its own.  Conversations that only ``originals`` has get zeros,
    an empty audit and the hash of nothing.  Extra columns are ignored.
    """
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    marks = written(marked(rows), "marked-turns")
    every = (rows if originals is None else originals).select(F.col("conv_id").cast("long")).distinct()
    # One row per conversation from each side, added up: null ids meet as well.
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("string")
    counts = counted(marks)
    sides = every.select("conv_id", *[zero.alias(c) for c in FIGURES], none.alias("audit")).unionByName(
        counts.select("conv_id", *FIGURES[:4], zero.alias("illegal"), zero.alias("cost"), none.alias("audit"))
    ).unionByName(audits(marks).select("conv_id", *[zero.alias(c) for c in FIGURES[:4]],
                                       "illegal", "cost", "audit"))
    results = sides.groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in FIGURES], F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    return repaired(rows, results)
