"""Operator 11, repair of a conversation's structure by a run-length dynamic program.

A row of a conversation is a symbol: the initial of its role and its fault. Four states say what may follow (nothing yet,
after the system turn, after a user turn, after an assistant turn), and a symbol is a 4 x 4 matrix of costs in the
min-plus semiring: delete, insert, keep, rerole. Equal consecutive symbols are one run, whose matrix is a binary power,
kept per symbol. A row of costs-to-go is pushed back through the runs; the audit is then unrolled from the front, halving a
run with the same powers, and takes the ASCII-least edit that still leads to the cheapest end.

Rows are range-partitioned by (conversation, turn, role, digest of the text), so a conversation of any size lies in
consecutive partitions, and no task holds more of it than a stretch of bounded rows and bytes. A conversation inside one
partition and one stretch is done at once. Of the others (two a partition, and the long ones) each stretch sends its matrix
alone; products from the right give every stretch its costs-to-go, each stretch unrolls from all four states, and a scan
from the left picks the state it begins in. Equal rows of a turn are one row with a count before anything is sent.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, stored, table

STRETCH_ROWS, STRETCH_BYTES = 65_536, 4 << 20
#: What the initials of a role and the names of edits cost.
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
NEVER = 1 << 60
WHITE = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. LEGAL: what an initial leads to; FILL: the
#: state after the one role that a reroled or inserted row can take.
LEGAL = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FILL = (2, 2, 3, 2)
ROLE_OF = {2: "user", 3: "assistant"}
#: Symbols: the initial of the role, in upper case if the text is cut short; "x" for a row that must go.
MUST_GO = "x"


def insert_first(costs: tuple) -> tuple:
    """Costs-to-go from a point where rows may be inserted, given those after the inserts (three inserts go in a circle)."""
    out = []
    for q in range(4):
        one = FILL[q]
        out.append(min(costs[q], INSERT + costs[one], 2 * INSERT + costs[FILL[one]]))
    return tuple(out)


@lru_cache(maxsize=64)
def step(symbol: str) -> tuple:
    """The matrix of one row, inserts before it included."""
    rows = [[NEVER] * 4 for _ in range(4)]
    extra = CUT_SHORT if symbol.isupper() else 0
    for q in range(4):
        rows[q][q] = DELETE
        if symbol != MUST_GO:
            rows[q][FILL[q]] = min(rows[q][FILL[q]], REROLE + extra)
            to = LEGAL[q].get(symbol.lower())
            if to is not None:
                rows[q][to] = min(rows[q][to], extra)
    return tuple(zip(*[insert_first(c) for c in zip(*rows, strict=True)], strict=True))


def product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(NEVER, *[a[i][k] + b[k][j] for k in range(4)]) for j in range(4)) for i in range(4))


@lru_cache(maxsize=1024)
def power(symbol: str, bit: int) -> tuple:
    """The matrix of 2 ** bit rows of a symbol."""
    if bit == 0:
        return step(symbol)
    half = power(symbol, bit - 1)
    return product(half, half)


def run_matrix(symbol: str, n: int) -> tuple:
    out = None
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            out = power(symbol, bit) if out is None else product(out, power(symbol, bit))
    return out


def back(matrix: tuple, costs: tuple) -> tuple:
    return tuple(min(NEVER, *[row[k] + costs[k] for k in range(4)]) for row in matrix)


def back_run(symbol: str, n: int, costs: tuple) -> tuple:
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            costs = back(power(symbol, bit), costs)
    return costs


IDENTITY = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))
#: Costs-to-go at the end: nothing at all and an assistant's turn are good, a user's turn lacks its answer.
END = insert_first((0, NEVER, NEVER, 0))


def unroll_run(symbol: str, n: int, q: int, after: tuple, out: list) -> int:
    """Appends the edits of ``n`` rows from state ``q``, given the costs-to-go ``after`` them; the state behind them."""
    if n > 1:
        half = 1 << ((n - 1).bit_length() - 1)
        q = unroll_run(symbol, n - half, q, back(power(symbol, half.bit_length() - 1), after), out)
        return unroll_run(symbol, half, q, after, out)
    left = back(step(symbol), after)
    extra = CUT_SHORT if symbol.isupper() else 0
    while True:
        if DELETE + after[q] == left[q]:
            out.append("D")
            return q
        if INSERT + left[FILL[q]] == left[q]:
            out.append("I")
            q = FILL[q]
            continue
        to = LEGAL[q].get(symbol.lower())
        if symbol != MUST_GO and to is not None and extra + after[to] == left[q]:
            out.append("K")
            return to
        out.append("R")
        return FILL[q]


def unroll(runs: tuple, q: int, after: tuple, last: bool) -> tuple[str, int]:
    """Edits of a stretch of runs from state ``q`` and the state behind it; the ``last`` stretch ends the conversation."""
    points = [after]
    for symbol, n in reversed(runs):
        points.append(back_run(symbol, n, points[-1]))
    points.reverse()
    if points[0][q] >= NEVER:
        return "", q
    out: list[str] = []
    for k, (symbol, n) in enumerate(runs):
        q = unroll_run(symbol, n, q, points[k + 1], out)
    while last and q not in (0, 3):
        out.append("I")
        q = FILL[q]
    return "".join(out), q


@lru_cache(maxsize=50_000)
def whole(runs: tuple) -> tuple[int, str]:
    """Cost and audit of a conversation."""
    costs = END
    for symbol, n in reversed(runs):
        costs = back_run(symbol, n, costs)
    return costs[0], unroll(runs, 0, END, True)[0]


def apply_edits(audit: str, runs, q: int, roles: list, texts: list) -> list:
    """The repaired rows as (role, text); ``roles`` and ``texts`` are those of the rows that need not go."""
    symbols = iter([(s, n) for s, n in runs])
    symbol, left, k, out = None, 0, 0, []
    for edit in audit:
        if edit == "I":
            q = FILL[q]
            out.append((ROLE_OF[q], ""))
            continue
        while not left:
            symbol, left = next(symbols)
        left -= 1
        if symbol == MUST_GO:
            continue
        if edit == "K":
            q = LEGAL[q][symbol.lower()]
            out.append((roles[k], texts[k]))
        elif edit == "R":
            q = FILL[q]
            out.append((ROLE_OF[q], texts[k]))
        k += 1
    return out


# rows


def damage(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after the query's damage; a dropped row has no copies."""
    space = F.lit(" ")
    d = df.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    d = d.withColumn("_x", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("_x") == 1, "").when(F.col("_x") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return d.select("conv_id", "turn", F.when(F.col("_x") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.when(F.col("_x") == 0, 0).when(F.col("_x") == 3, 2).otherwise(1).cast("long").alias("copies"))


def faults(df: DataFrame) -> DataFrame:
    """One row for equal rows of a turn: its number of copies, and the first fault of the first copy ('' if none).

    A row is a duplicate if role and text (compared by SHA-256) stand in an earlier row of the conversation.
    """
    d = df.select(F.coalesce("conv_id", F.lit(0).cast("long")).alias("_c"), F.col("conv_id").isNull().alias("_cn"), F.coalesce("turn", F.lit(0).cast("long")).alias("_t"),
                  F.col("turn").isNotNull().alias("_tn"), "role", F.sha2("text", 256).alias("_h"), "text", "copies")
    key = ["_cn", "_c", "_tn", "_t", "role", "_h"]
    rows = d.groupBy(*key).agg(F.sum("copies").alias("copies"), F.max("text").alias("text"))
    first = d.where("copies > 0").groupBy("_cn", "_c", "role", "_h").agg(F.min(F.struct("_tn", "_t")).alias("_f"))
    first = first.select("_cn", "_c", "_f._tn", "_f._t", "role", "_h", F.lit(True).alias("_first"))
    body = F.rtrim("text", F.lit(WHITE))
    fault = F.when(body == "", "blank").when(F.col("_first").isNull(), "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.join(first, key, "left").select(*key, "copies", fault.alias("fault"), "text")


STRETCH = ("conv_id long, part int, seq int, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, lo long, hi long, "
           "head string, tail string, cost long, audit string, repaired array<struct<role: string, text: string>>, "
           "matrix array<long>, symbols array<string>, lengths array<long>, roles array<string>, texts array<string>")


class Stretch:
    """What is known of a stretch while its rows pass."""

    def __init__(self) -> None:
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.turns = self.rows = self.bytes = 0
        self.lo = self.hi = self.head = self.tail = None
        self.runs: list[list] = []
        self.roles: list[str] = []
        self.texts: list[str] = []

    def add(self, turn, role: str, copies: int, fault: str, text: str) -> None:
        initial = role[:1]
        if self.tail is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in ("su", "ua", "au")
        self.illegal += copies - 1  # a copy beside itself
        self.tail = initial
        if turn is not None and turn != self.hi:
            self.turns += 1
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        if fault:
            self.counts[fault] += 1
        self.counts["blank" if fault == "blank" else "duplicate"] += copies - 1
        goes = fault in ("blank", "duplicate")
        letter = initial if initial in ("s", "u", "a") else "o"
        self._run(MUST_GO if goes else letter.upper() if fault else letter, 1)
        self._run(MUST_GO, copies - 1)
        if not goes:
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)
        self.rows += 1

    def _run(self, symbol: str, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([symbol, n])

    def row(self, conv, part: int, seq: int, done: bool) -> tuple:
        runs = tuple((s, n) for s, n in self.runs)
        begin = (conv, part, seq, done, *self.counts.values(), self.illegal, self.turns, self.lo, self.hi, self.head, self.tail)
        if done:
            cost, audit = whole(runs)
            fixed = [{"role": r, "text": t} for r, t in apply_edits(audit, runs, 0, self.roles, self.texts)]
            return *begin, cost, audit, fixed, None, None, None, None, None
        m = IDENTITY
        for s, n in runs:
            m = product(m, run_matrix(s, n))
        return *begin, None, None, None, [x for r in m for x in r], [s for s, _ in runs], [n for _, n in runs], self.roles, self.texts


def _stretches(schema, rows: int, size: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        key, now, seq, cut, first, held = None, None, 0, False, True, 0
        for whole_batch in batches:
            for b in slices(whole_batch, 7):
                for cn, c, tn, t, role, copies, fault, text in zip(*[b.column(k).to_pylist() for k in range(8)], strict=True):
                    if (cn, c) != key:
                        if now is not None:
                            out.append(now.row(None if key[0] else key[1], part, seq, not first and not cut))
                            held, first, seq = held + now.bytes, False, seq + 1
                        key, now, cut = (cn, c), Stretch(), False
                    elif now.rows >= rows or now.bytes >= size:
                        out.append(now.row(None if key[0] else key[1], part, seq, False))
                        held, now, seq, cut = held + now.bytes, Stretch(), seq + 1, True
                    if copies:
                        now.add(t if tn else None, role, copies, fault, text)
                    if len(out) >= 10_000 or held >= size:
                        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
        if now is not None:
            out.append(now.row(None if key[0] else key[1], part, seq, False))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _ends(t: pa.Table) -> pa.Table:
    """Costs-to-go behind each stretch of one conversation."""
    rows = sorted(t.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    costs, out = END, []
    for k, r in enumerate(reversed(rows)):
        out.append((r["part"], r["seq"], list(costs), k == 0))
        m = r["matrix"]
        costs = back(tuple(tuple(m[4 * i: 4 * i + 4]) for i in range(4)), costs)
    cost = [costs[0] if k == len(rows) - 1 else 0 for k in range(len(rows))]
    names, types = ["part", "seq", "after", "last", "cost"], [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.int64()]
    cols = [*zip(*out, strict=True), cost]
    return pa.table({n: pa.array(c, type=x) for n, c, x in zip(names, cols, types, strict=True)})


def _unrolled(batches):
    for whole_batch in batches:
        for k in range(whole_batch.num_rows):  # a stretch may be megabytes
            r = whole_batch.slice(k, 1).to_pylist()[0]
            runs, after = tuple(zip(r["symbols"], r["lengths"], strict=True)), tuple(r["after"])
            ways = [unroll(runs, q, after, r["last"]) for q in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["seq"]], pa.int32()), pa.array([[a for a, _ in ways]], pa.list_(pa.string())),
                                              pa.array([[q for _, q in ways]], pa.list_(pa.int32()))], names=["part", "seq", "audits", "stops"])


def _starts(t: pa.Table) -> pa.Table:
    """The state each stretch begins in, and what its border with the one before adds."""
    rows = sorted(t.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    q, tail, hi, out = 0, None, None, []
    for r in rows:
        border = int(tail is not None and r["head"] is not None and tail + r["head"] not in ("su", "ua", "au"))
        shared = int(hi is not None and r["lo"] == hi)
        out.append((r["part"], r["seq"], q, border, shared))
        q = r["stops"][q]
        tail, hi = r["tail"] if r["tail"] is not None else tail, r["hi"] if r["hi"] is not None else hi
    names, types = ["part", "seq", "start", "border", "shared"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table({n: pa.array(c, type=x) for n, c, x in zip(names, zip(*out, strict=True), types, strict=True)})


def _repaired(schema):
    def run(batches):
        for whole_batch in batches:
            for k in range(whole_batch.num_rows):
                r = whole_batch.slice(k, 1).to_pylist()[0]
                runs = list(zip(r["symbols"], r["lengths"], strict=True))
                fixed = [{"role": a, "text": b} for a, b in apply_edits(r["audit"], runs, r["start"], r["roles"], r["texts"])]
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["seq"]], pa.int32()), pa.array([fixed], schema.field("repaired").type)], schema=schema)

    return run


def repair(df: DataFrame, stretch_rows: int = STRETCH_ROWS, stretch_bytes: int = STRETCH_BYTES) -> DataFrame:
    """Stretches of repaired conversations: conv_id, part and seq (their order; unique), whole (the only stretch), blank, duplicate,
    truncated, illegal, turns (distinct, not null), lo and hi (least and greatest turn), cost, audit, repaired.

    ``df``: conv_id, turn, role, text and optionally copies (how often a row stands; 0: not at all); others are ignored.
    Rows of a conversation go by turn (nulls first), then role, then SHA-256 of the text. A null role or text is one space;
    a null conv_id is a conversation of its own. Equal rows are duplicates of one another. Counts of stretches of a
    conversation add up; costs stand at its first stretch. A conversation whose rows all have no copies is one with no rows.
    An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = prepare(df)
    copies = F.col("copies").cast("long") if "copies" in df.columns else F.lit(1).cast("long")
    df = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                   F.coalesce(F.col("text"), F.lit(" ")).alias("text"), copies.alias("copies"))
    ddl = _parse_datatype_string(STRETCH)
    order = ["_cn", "_c", "_tn", "_t", "role", "_h"]
    rows = faults(df).repartitionByRange(*order).sortWithinPartitions(*order).drop("_h")
    rows = stored(spark, rows.mapInArrow(_stretches(to_arrow_schema(ddl), stretch_rows, stretch_bytes), ddl), "turns")
    shown = ["conv_id", "part", "seq", "whole", "blank", "duplicate", "truncated", "illegal", "turns", "lo", "hi", "cost", "audit", "repaired"]
    parts = rows.where("not whole")
    ends = parts.select("conv_id", "part", "seq", "matrix").groupBy("conv_id").applyInArrow(_ends, "part int, seq int, after array<long>, last boolean, cost long")
    ends = stored(spark, ends, "turn-ends")
    ways = parts.select("part", "seq", "symbols", "lengths").join(ends, ["part", "seq"]).mapInArrow(_unrolled, "part int, seq int, audits array<string>, stops array<int>")
    ways = stored(spark, ways, "turn-ways")
    starts = parts.select("conv_id", "part", "seq", "head", "tail", "lo", "hi").join(ways.select("part", "seq", "stops"), ["part", "seq"])
    starts = starts.groupBy("conv_id").applyInArrow(_starts, "part int, seq int, start int, border long, shared long")
    found = starts.join(ways, ["part", "seq"]).join(ends, ["part", "seq"]).select("part", "seq", "start", "border", "shared", "cost", F.expr("audits[start]").alias("audit"))
    found = stored(spark, found, "turn-edits")
    fixed = parts.select("part", "seq", "symbols", "lengths", "roles", "texts").join(found.select("part", "seq", "start", "audit"), ["part", "seq"])
    schema = _parse_datatype_string("part int, seq int, repaired array<struct<role: string, text: string>>")
    fixed = fixed.mapInArrow(_repaired(to_arrow_schema(schema)), schema)
    parts = parts.drop("cost", "audit", "repaired").join(found, ["part", "seq"]).join(fixed, ["part", "seq"])
    parts = parts.withColumn("illegal", F.col("illegal") + F.col("border")).withColumn("turns", F.col("turns") - F.col("shared"))
    return rows.where("whole").select(*shown).unionByName(parts.select(*shown))


def _hashed(batches):
    """SHA-256 over the stretches of conversations that come in order: state and one stretch are all that is held."""
    key, h, any_row = None, None, False
    for b in batches:
        out = []
        for k in range(b.num_rows):
            r = b.slice(k, 1).to_pylist()[0]
            if key is None or key[0] != r["conv_id"]:
                if key is not None:
                    out.append((key[0], h.hexdigest()))
                key, h, any_row = (r["conv_id"],), hashlib.sha256(), False
            for x in r["repaired"]:
                h.update((("\n" if any_row else "") + x["role"] + ":" + x["text"]).encode())
                any_row = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], names=["conv_id", "repaired_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def conversations(stretches: DataFrame) -> DataFrame:
    """One row per conversation: gaps, counts, cost, the whole audit and SHA-256 of the repaired rows (``role:text`` by line)."""
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    line = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    one = stretches.where("whole").select("conv_id", gaps, *counts, "audit", F.sha2(line, 256).alias("repaired_sha256"))
    more = stretches.where("not whole")
    summed = more.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in [*counts, "turns"]], F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                         F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    hashed = more.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").select("conv_id", "repaired").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    both = summed.join(hashed, summed["conv_id"].eqNullSafe(hashed["conv_id"])).select(summed["conv_id"], gaps, *counts, "audit", "repaired_sha256")
    return one.unionByName(both)


def op11_turn_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation after the damage of the contract: faults, cheapest edits, digest of the repaired rows."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations(repair(damage(d)))


#: DuckDB has no CRC: ``crc_table`` holds the remainders of a byte. Costs-to-go run over rows from the last, edits from the first.
OP11_SQL = """
with recursive crc_table as (
  select list(v order by i) t from (
    select i, list_reduce([i::bigint, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v
    from range(256) r(i))
), x as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))), '..'),
             lambda b: ('0x' || b)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as k
  from conversations, crc_table
), d as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
         case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when k = 3 then 2 else 1 end)) as copy
  from x where k > 0
), o as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n, role[1] as c, lag(role[1]) over w as p,
         rtrim(text, e' \\t\\n\\x0b\\x0c\\r') as body, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again
  from d window w as (partition by conv_id order by turn nulls first, role, sha256(text), copy)
), f as (
  select *, case when body = '' then 1 when again > 1 then 2 when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault from o
), g as (
  select *, fault in (1, 2) as goes, case when fault = 3 then 5 else 0 end as extra from f
), b as (
  select conv_id, max(n) + 1 as i, 0::bigint as b0, 10::bigint as b1, 5::bigint as b2, 0::bigint as b3 from g group by conv_id
  union all
  select conv_id, i, least(m0, 5 + m2, 10 + m3), least(m1, 5 + m2, 10 + m3), least(m2, 5 + m3), least(m3, 5 + m2) from (
    select g.conv_id, g.i,
           least(2 + b0, case when goes then 1e9::bigint else 1 + extra + b2 end, case when not goes and c = 's' then extra + b1 when not goes and c = 'u' then extra + b2 else 1e9::bigint end) as m0,
           least(2 + b1, case when goes then 1e9::bigint else 1 + extra + b2 end, case when not goes and c = 'u' then extra + b2 else 1e9::bigint end) as m1,
           least(2 + b2, case when goes then 1e9::bigint else 1 + extra + b3 end, case when not goes and c = 'a' then extra + b3 else 1e9::bigint end) as m2,
           least(2 + b3, case when goes then 1e9::bigint else 1 + extra + b2 end, case when not goes and c = 'u' then extra + b2 else 1e9::bigint end) as m3
    from b join g on g.conv_id is not distinct from b.conv_id and g.i = b.i - 1)
), v as (
  select g.*, [p.b0, p.b1, p.b2, p.b3] as here, [q.b0, q.b1, q.b2, q.b3] as later
  from g join b p on p.conv_id is not distinct from g.conv_id and p.i = g.i join b q on q.conv_id is not distinct from g.conv_id and q.i = g.i + 1
), u as (
  select conv_id, 1::bigint as i, 1 as q, '' as audit, []::varchar[] as rows_, max(n) as n from g group by conv_id
  union all
  select conv_id, case when e = 'I' then i else i + 1 end, case e when 'D' then q when 'K' then to_ else fill end, audit || e,
         case e when 'D' then rows_ when 'I' then list_append(rows_, case fill when 4 then 'assistant:' else 'user:' end)
                when 'K' then list_append(rows_, role || ':' || text) else list_append(rows_, case fill when 4 then 'assistant:' else 'user:' end || text) end, n
  from (
    select *, case when 2 + later[q] = here[q] then 'D' when 5 + here[fill] = here[q] then 'I'
                   when not goes and to_ is not null and extra + later[to_] = here[q] then 'K' else 'R' end as e
    from (select u.conv_id, u.i, u.q, u.audit, u.rows_, u.n, v.role, v.text, v.goes, v.extra, v.here, v.later, case when u.q = 3 then 4 else 3 end as fill,
                 case when v.c = 's' and u.q = 1 then 2 when v.c = 'u' and u.q <> 3 then 3 when v.c = 'a' and u.q = 3 then 4 end as to_
          from u join v on v.conv_id is not distinct from u.conv_id and v.i = u.i))
), z as (
  select conv_id, case q when 3 then audit || 'I' when 2 then audit || 'II' else audit end as audit,
         case q when 3 then list_append(rows_, 'assistant:') when 2 then list_append(list_append(rows_, 'user:'), 'assistant:') else rows_ end as rows_
  from u where i = n + 1
), s as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
         count(*) filter (fault = 3) as truncated, count(*) filter (p is not null and coalesce(p || c, '') not in ('su', 'ua', 'au')) as illegal
  from g group by conv_id
)
select a.conv_id, coalesce(s.gaps, 0) as gaps, coalesce(s.blank, 0) as blank, coalesce(s.duplicate, 0) as duplicate, coalesce(s.truncated, 0) as truncated,
       coalesce(s.illegal, 0) as illegal, coalesce(b.b0, 0) as cost, coalesce(z.audit, '') as audit, sha256(coalesce(array_to_string(z.rows_, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join s on s.conv_id is not distinct from a.conv_id left join z on z.conv_id is not distinct from a.conv_id
left join b on b.conv_id is not distinct from a.conv_id and b.i = 1
"""
