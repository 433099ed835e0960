"""Repair of conversations: the cheapest edits that give every dialogue a legal order of roles.

A conversation may open with a system turn and then alternates between user and
assistant, who has the last word. Turns are placed in order once, and cut into
segments of a few turns that are dealt by hash; within a task a recursive DuckDB
query advances one turn for all its segments at once and keeps, for each state
of the grammar before and after, the least cost and the edits that reach it.
Segments of one conversation are put together by the same recursion, one
segment for all conversations at a time, so a conversation of any length is
work of many tasks and no recursion is deep. At last the chosen edits are
applied to the texts, which stream by in order.
"""

from __future__ import annotations

import hashlib
from itertools import product

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.ranking import placed

from .common import bounded_broadcast, discard, materialize, table

#: Turns in a segment, and segments put together at a time.
SEGMENT = 64
#: Repeated turns of which a conversation's first is looked up: so many may be broadcast.
REPEATS = 200_000
SALT = 16

#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar states: nothing yet, after system, after user, after assistant. Legal ends are the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
#: What the state after a turn of an initial is, where it is legal.
LEGAL = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: A turn in one letter: its initial (o: another) in small if sound, in capitals if truncated, a digit if blank (1 to 4) or a duplicate (5 to 8).
INITIALS = "suao"
CODES = "suaoSUAO12345678"

CELLS = "array<struct<a:int,b:int,cost:long,audit:string>>"


def expected(state: int) -> str:
    """The role that the grammar wants next, apart from an opening system turn."""
    return "assistant" if state == USER else "user"


def _steps() -> list[tuple[str, int, int, int, str]]:
    """(code, state before, state after, cost, edits): the least of each turn, with up to two inserts before it. More inserts only go in circles."""
    best: dict[tuple[str, int, int], tuple[int, str]] = {}
    for code, start, inserts in product(CODES, range(4), range(3)):
        state, cost, edits = start, inserts * INSERT, "I" * inserts
        for _ in range(inserts):
            state = LEGAL[state, expected(state)[0]]
        fault, initial = divmod(CODES.index(code), 4)
        choices = [(state, DELETE, "D")]
        if fault < 2:
            choices.append((LEGAL[state, expected(state)[0]], REROLE + fault * TRUNCATED, "R"))
            if (state, INITIALS[initial]) in LEGAL:
                choices.append((LEGAL[state, INITIALS[initial]], fault * TRUNCATED, "K"))
        for end, price, edit in choices:
            key, new = (code, start, end), (cost + price, edits + edit)
            best[key] = min(best.get(key, new), new)
    return [(*k, *v) for k, v in sorted(best.items())]


STEPS = _steps()

#: One row (id, place, a, b, cost, audit) for each way through each part; each recursion goes on by one part of all ids.
_ADVANCE = """
with recursive size as (
  select id, max(place) + 1 as n from parts group by id
), way(id, a, b, place, best) as (
  select id, a, a, 0, {'cost': cast(0 as bigint), 'audit': ''} from size, (select unnest([0, 1, 2, 3]) as a)
  union all
  select way.id, way.a, parts.b, any_value(way.place) + 1, min({'cost': way.best.cost + parts.cost, 'audit': way.best.audit || parts.audit})
  from way join parts on parts.id = way.id and parts.place = way.place and parts.a = way.b
  group by way.id, way.a, parts.b
)
select way.id, list({'a': way.a, 'b': way.b, 'cost': way.best.cost, 'audit': way.best.audit} order by way.a, way.b) as cells
from way join size on size.id = way.id and size.n = way.place group by way.id order by way.id
"""

_OF_TURNS = """
create or replace temp table parts as
select t.id, t.place, step.a, step.b, step.cost, step.audit
from (select id, unnest(range(length(codes))) as place, unnest(string_split(codes, '')) as code from batch) t join step on step.code = t.code
"""

_OF_SEGMENTS = """
create or replace temp table parts as
select id, place, c.a as a, c.b as b, c.cost as cost, c.audit as audit
from (select id, place, unnest(cells) as c from (select id, unnest(range(len(segments))) as place, unnest(segments).cells as cells from batch))
"""


def _advanced(parts_sql: str, column: str):
    """Arrow batches whose last column (``column``) is parts of conversations, to the cells of their whole."""

    def run(batches):
        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        con.execute("create table step(code varchar, a int, b int, cost bigint, audit varchar)")
        con.executemany("insert into step values (?, ?, ?, ?, ?)", STEPS)
        for b in batches:
            if not b.num_rows:
                continue
            batch = pa.table({"id": pa.array(range(b.num_rows), pa.int32()), column: b.columns[-1]})
            con.register("batch", batch)
            con.execute(parts_sql)
            cells = con.sql(_ADVANCE).to_arrow_table().column("cells").combine_chunks()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], cells], names=[*b.schema.names[:-1], "cells"])
        con.close()

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after faults drawn by crc32 of id and turn: dropped, emptied, without ends of sentences, repeated, or said by the user. Nulls are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), copies).drop("copy")


def _known(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, sha): what orders turns of equal number is their role and the SHA-256 of their text."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))


def _same(a: str, b: str, *cols: str):
    out = F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    for c in cols:
        out = out & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return out


def coded(turns: DataFrame) -> DataFrame:
    """Stored (conv_id, place, turn, code) of ``_known`` turns: exact places in the order of conversations and turns, and what each turn is."""
    last = F.substring(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", ""), -1, 1)
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    initial = F.when((F.col("role") == "") | (initial == 0) | (initial == 4), 4).otherwise(initial)
    narrow = turns.select("conv_id", "turn", "role", "sha", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), initial.alias("initial"))
    narrow = materialize(narrow, "turns")
    order = [("conv_id", False), ("turn", False), ("role", False), ("sha", False)]
    rows = materialize(placed(narrow, order, "place"), "placed")
    discard(narrow)
    firsts = rows.where("not blank").groupBy("conv_id", "role", "sha").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(firsts.select("conv_id", "role", "sha", "first"), "repeats")
    count = firsts.count()
    if count <= REPEATS:
        met = rows.alias("t").join(bounded_broadcast(firsts, count, REPEATS).alias("f"), _same("t", "f", "role", "sha"), "left")
    else:
        copies = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = rows.withColumn("salt", (F.col("place") % SALT).cast("int")).alias("t").join(copies.alias("f"), _same("t", "f", "role", "sha", "salt"), "left")
    fault = F.when(F.col("blank"), 2).when(F.col("place") > F.col("first"), 3).when(F.col("cut"), 1).otherwise(0)
    code = F.substring(F.lit(CODES), (fault * 4 + F.col("initial")).cast("int"), F.lit(1))
    return materialize(met.select(F.col("t.conv_id").alias("conv_id"), "place", "turn", code.alias("code")), "coded")


def _pieces(df: DataFrame, group, value: str, out: str) -> DataFrame:
    """(conv_id, segment, out): the ``value`` of a group's rows in their order; a group has ``SEGMENT`` rows at most."""
    rows = F.array_sort(F.collect_list(F.struct("place", value)))
    return df.groupBy("conv_id", group.cast("long").alias("segment")).agg(rows.alias(out))


def cheapest(codes: DataFrame, id_type: str) -> DataFrame:
    """(conv_id, codes, cost, audit) of every conversation that has a turn in ``coded`` rows."""
    segments = _pieces(codes, F.floor(F.col("place") / SEGMENT), "code", "codes").withColumn("codes", F.array_join(F.transform("codes", lambda x: x["code"]), ""))
    segments = materialize(segments, "segments")
    solved = segments.mapInArrow(_advanced(_OF_TURNS, "codes"), f"conv_id {id_type}, place long, cells {CELLS}")
    level, whole = materialize(solved, "cells"), []
    while True:
        several = materialize(level.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id"), "several")
        n = several.count()
        if not n:
            whole.append(level)
            break
        split = lambda how, n=n, level=level, several=several: level.alias("t").join(bounded_broadcast(several, n).alias("f"), _same("t", "f"), how)
        whole.append(split("left_anti"))
        parts = _pieces(split("left_semi"), F.floor(F.col("place") / SEGMENT), "cells", "segments")
        level = materialize(parts.mapInArrow(_advanced(_OF_SEGMENTS, "segments"), f"conv_id {id_type}, place long, cells {CELLS}"), "cells")
    cells = whole[0]
    for more in whole[1:]:
        cells = cells.unionByName(more)
    finish = F.create_map(*[x for b, (cost, edits) in ENDS.items() for x in (F.lit(b), F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(edits).alias("audit")))])
    ended = lambda c: F.struct((c["cost"] + finish[c["b"]]["cost"]).alias("cost"), F.concat(c["audit"], finish[c["b"]]["audit"]).alias("audit"))
    best = F.array_min(F.transform(F.filter("cells", lambda c: c["a"] == NOTHING), ended))
    results = cells.select("conv_id", F.lit(None).cast("string").alias("codes"), best.alias("best"))
    texts = segments.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "codes"))), lambda x: x["codes"]), "").alias("codes"))
    both = results.unionByName(texts.withColumn("best", F.lit(None).cast("struct<cost:long,audit:string>")))
    found = both.groupBy("conv_id").agg(F.max("codes").alias("codes"), F.max("best").alias("best"))
    return found.select("conv_id", "codes", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))


HEAD = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def heads(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Stored (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of ``turns``, and of ``ids`` (conv_id) without any."""
    codes = coded(_known(turns))
    id_type = turns.schema["conv_id"].dataType.simpleString()
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    per = codes.groupBy("conv_id").agg(gaps.alias("gaps"))
    best = cheapest(codes, id_type)
    rows = per.unionByName(best, allowMissingColumns=True)
    if ids is not None:
        rows = rows.unionByName(ids.select("conv_id").distinct(), allowMissingColumns=True)
    rows = rows.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("gaps", "codes", "cost", "audit")])
    codes_of = F.coalesce("codes", F.lit(""))
    count = lambda pattern: F.regexp_count(codes_of, F.lit(pattern)).cast("long")
    initials = F.translate(codes_of, CODES, INITIALS * 4)
    pairs = F.greatest(F.length(codes_of) - 1, F.lit(0)) - F.regexp_count(initials, F.lit("(?=su|ua|au)"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = rows.select("conv_id", zero("gaps"), count("[1-4]").alias("blank"), count("[5-8]").alias("duplicate"), count("[SUAO]").alias("truncated"), pairs.cast("long").alias("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"))
    return materialize(out, "heads")


class Repairer:
    """Applies a conversation's edits to its turns as they come: yields (role, text, edit) of the turns of the repaired one."""

    def __init__(self, audit: str):
        self.edits, self.state = iter(audit), NOTHING

    def _made(self, role: str, text: str, edit: str):
        self.state = LEGAL[self.state, role[0]]
        return role, text, edit

    def turn(self, role: str, text: str):
        for edit in self.edits:
            if edit == "I":
                yield self._made(expected(self.state), "", edit)
                continue
            if edit == "R":
                yield self._made(expected(self.state), text, edit)
            elif edit == "K":
                yield self._made(role, text, edit)
            return

    def rest(self):
        for edit in self.edits:
            yield self._made(expected(self.state), "", edit)


def _in_order(turns: DataFrame, head: DataFrame) -> DataFrame:
    """Each conversation's head and behind it its turns in order, all in one partition, where they are sorted and stream by."""
    rows = _known(turns).select("conv_id", "turn", "role", "sha", "text", *[F.lit(None).cast("long").alias(c) for c in HEAD], F.lit(None).cast("string").alias("audit"))
    first = head.select("conv_id", *HEAD, "audit")
    both = rows.unionByName(first, allowMissingColumns=True).withColumn("kind", F.col("audit").isNull())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "sha").select("conv_id", "kind", "turn", "role", "text", *HEAD, "audit")


def _hashed(batches):
    """A row for each head with the SHA-256 of the repaired turns, which is fed turn by turn."""
    names = ["conv_id", *HEAD, "audit", "repaired_sha256"]
    head = repairer = digest = None
    begun = False

    def feed(made):
        nonlocal begun
        for role, text, _ in made:
            digest.update((("\n" if begun else "") + role + ":" + text).encode())
            begun = True

    for b in batches:
        done = []
        for conv_id, kind, _, role, text, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind:
                feed(repairer.turn(role, text))
                continue
            if head:
                feed(repairer.rest())
                done.append((*head, digest.hexdigest()))
            head, repairer, digest, begun = (conv_id, *rest), Repairer(rest[-1]), hashlib.sha256(), False
        yield _batch(done, b.schema, names)
        schema = b.schema
    if head:
        feed(repairer.rest())
        yield _batch([(*head, digest.hexdigest())], schema, names)


def _batch(rows: list[tuple], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    kinds = [schema.field("conv_id").type, *[pa.int64()] * len(HEAD), pa.string(), pa.string()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def repairs(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    ``turns`` are (conv_id, turn, role, text) rows; of equal turn numbers (null
    first) the order is that of role, then of the SHA-256 of the text. Null
    role and text are one space, a null conv_id is a conversation of its own,
    equal rows are turns of which the later are duplicates. Conversations of
    ``ids`` (conv_id) without a turn have zeros and empty edits; an empty table
    gives an empty table. Other columns do not matter. Costs, edits and counts
    of a long conversation are work of many tasks; its hash, which is one chain
    over all its text, is fed from a sorted stream in one task, without holding it.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()
    kinds = ", ".join(f"{c} long" for c in HEAD)
    return _in_order(turns, heads(turns, ids)).mapInArrow(_hashed, f"conv_id {id_type}, {kinds}, audit string, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns of the repaired conversations; edit is K, R or I, deleted turns are gone."""
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def run(batches):
        repairer, conv, place, kind_of = None, None, 0, None
        for b in batches:
            kind_of = b.schema.field("conv_id").type
            out = []
            for conv_id, kind, _, role, text, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind:
                    made = repairer.turn(role, text)
                else:
                    made = [] if repairer is None else list(repairer.rest())
                out += [(conv, place + i, *m) for i, m in enumerate(made, 1)]
                place = out[-1][1] if out and out[-1][0] == conv else place
                if not kind:
                    repairer, conv, place = Repairer(rest[-1]), conv_id, 0
            yield _turns(out, kind_of)
        if repairer is not None:
            yield _turns([(conv, place + i, *m) for i, m in enumerate(repairer.rest(), 1)], kind_of)

    return _in_order(turns, heads(turns)).mapInArrow(run, f"conv_id {id_type}, place long, role string, text string, edit string")


def _turns(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "place", "role", "text", "edit"])


def op13_dialogue(spark, sf_dir: str) -> DataFrame:
    """Every conversation after damage, repaired."""
    raw = table(spark, sf_dir, "conversations")
    return repairs(damaged(raw), raw)
