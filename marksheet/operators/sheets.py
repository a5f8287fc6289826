"""Answer sheets: a student is one row with the numbers of answered questions and arrays of grades.

Questions get numbers. A task lays the sheets of some students side by side, a place for every
question, and sums each exam's places for all of them at once: who has all of an exam's questions sits
it, and the sums are the totals. Exams are sent to the tasks, no row is made for a question, and the
first shuffle after the sheets is of counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import to_numeric
from ..sources.io import settled

EXAM = ["test_id", "test_size"]
#: Exams are sent in blocks of at most about so many (exam, question) entries.
ENTRIES = 1_000_000


def many_parts(df: DataFrame) -> int:
    """So many partitions that heavy work on few rows is spread, too; a number given is not lowered at run time."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def number_questions(exam: DataFrame) -> DataFrame:
    """(question_id, number from 0) for the questions of all exams, which are a dimension."""
    pool = exam.where(F.col("question_id").isNotNull()).agg(F.array_sort(F.collect_set("question_id")).alias("_q"))
    return pool.select(F.posexplode("_q").alias("number", "question_id")).select("question_id", "number")


def answer_sheets(answers: DataFrame, numbers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per student: the numbers of answered questions in order, and as many rows, and per
    column as many grades and sums of grades.

    Rows without student or question are left out; several answers to a question are added up.
    """
    number = lambda c: to_numeric(F.col(f"`{c}`"))
    sums = [a for c in columns for a in (F.count(number(c)).cast("double").alias(f"v_{c}"), F.coalesce(F.sum(number(c)), F.lit(0.0)).alias(f"t_{c}"))]
    known = answers.where(F.col("member_id").isNotNull()).join(F.broadcast(numbers), "question_id").repartition(many_parts(answers), "member_id")
    per_question = known.groupBy("member_id", "number").agg(F.count(F.lit(1)).cast("double").alias("n_rows"), *sums)
    names = ["n_rows", *(f"{k}_{c}" for c in columns for k in ("v", "t"))]
    sheet = per_question.groupBy("member_id").agg(F.sort_array(F.collect_list(F.struct("number", *names))).alias("_s"))
    return sheet.select("member_id", *(F.col("_s")[n].alias(n) for n in ("number", *names)))


def _sat(sheets: DataFrame, exams: list, columns: Sequence[str]) -> DataFrame:
    """The sittings of some exams (test_id, test_size, numbers of questions)."""
    names = ["n_rows", *(f"{k}_{c}" for c in columns for k in ("v", "t"))]
    whole = {"n_rows", *(f"v_{c}" for c in columns)}
    flat = np.array([q for x in exams for q in x["numbers"]], np.int64)
    starts = np.cumsum([0, *(len(x["numbers"]) for x in exams)])[:-1]
    sent = sheets.sparkSession.sparkContext.broadcast((flat, starts, [x["test_id"] for x in exams], np.array([x["test_size"] for x in exams], np.int32)))
    member = sheets.schema["member_id"].dataType.simpleString()
    out = ["test_id", "test_size", "member_id", "n_questions", *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, ids, sizes = sent.value
        ids, places = pa.array(ids), int(flat.max()) + 1
        step = max(1, 1_000_000 // len(flat))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            lists = batch.column(1)
            number = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))

            def over_exams(values: np.ndarray, row=row, number=number, rows=batch.num_rows) -> np.ndarray:
                laid = np.zeros((rows, places))
                inside = number < places
                laid[row[inside], number[inside]] = values[inside]
                return np.add.reduceat(laid[:, flat], starts, axis=1)

            found = over_exams(np.ones(len(number)))
            student, exam = np.nonzero(found == sizes)
            made = [ids.take(pa.array(exam)), pa.array(sizes[exam], pa.int32()), batch.column(0).take(pa.array(student)), pa.array(sizes[exam].astype(np.int64))]
            for i, name in enumerate(names):
                total = over_exams(batch.column(2 + i).flatten().to_numpy(zero_copy_only=False))[student, exam]
                made.append(pa.array(total.astype(np.int64) if name in whole else total))
            yield pa.RecordBatch.from_arrays(made, names=out)

    kinds = ", ".join(f"`{n}` {'long' if n in whole else 'double'}" for n in names)
    return sheets.mapInArrow(run, f"test_id string, test_size int, member_id {member}, n_questions long, {kinds}")


def _in_blocks(exam: DataFrame, answers: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[list]]:
    """The sheets, and the exams (test_id, test_size, numbers of questions) in blocks of about ``ENTRIES``."""
    exam = settled(exam.select(*EXAM, "question_id"), "exams")
    numbers = number_questions(exam)
    sheets = answer_sheets(answers, numbers, columns)
    rows = exam.join(F.broadcast(numbers), "question_id").groupBy(*EXAM).agg(F.array_sort(F.collect_set("number")).alias("numbers")).where(F.size("numbers") == F.col("test_size"))
    blocks = max(1, -(-exam.count() // ENTRIES))
    parts = (rows.where(F.pmod(F.xxhash64(*EXAM), F.lit(blocks)) == b).collect() for b in range(blocks))
    return sheets, [some for some in parts if some]


def sittings(exam: DataFrame, answers: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """One row per exam and student who answered all its questions: n_rows, n_questions, and per
    column v_ (valid grades) and t_ (total).

    The exams are written down and sent to the tasks in blocks; an exam with other than ``test_size``
    questions has no sitting.
    """
    sheets, blocks = _in_blocks(exam, answers, columns)
    parts = [_sat(sheets, some, columns) for some in blocks]
    return reduce(DataFrame.unionByName, parts) if parts else _sat(sheets.limit(0), [{"test_id": "", "test_size": 1, "numbers": [0]}], columns)


#: Bytes of laid-out sheets that a counting task holds.
HELD = 128 << 20


def _chunks(batches: Iterator[pa.RecordBatch], row_bytes: int) -> Iterator[pa.Table]:
    """The sheets of a task in tables of about ``HELD`` bytes."""
    most, held, rows = max(1, HELD // row_bytes), [], 0
    for b in batches:
        for i in range(0, b.num_rows, most):
            part = b.slice(i, most)
            if rows + part.num_rows > most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _steps(values: list[np.ndarray], most: int) -> float | None:
    """A power of two by which all values become whole, with exact sums of ``most`` of them; None if there is none."""
    for k in range(11):
        if all(np.isfinite(v).all() and (np.abs(v) * (1 << k) * most < 1 << 30).all() and (v * (1 << k) == np.rint(v * (1 << k))).all() for v in values):
            return float(1 << k)
    return None


def _different(sheets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The different sheets, how many students (times) have each, and whether it is plain: one row a question."""
    alike = ["number", "n_rows", *(f"{k}_{c}" for c in columns for k in ("v", "t"))]
    return settled(sheets.groupBy(*alike).agg(F.count(F.lit(1)).cast("double").alias("times")).select("times", *alike, (F.array_max("n_rows") == 1).alias("plain")), "sheets")


def _dealt(sheets: DataFrame, many: int, most: int, exams: int) -> tuple[DataFrame, int, int]:
    """Blocks of sheets crossed with blocks of exams, a task each, and how many blocks there are of both.

    Counts are made of a block of at most about ``most`` sheets, so as few blocks as that allows leave
    few counts to be added up; where they are fewer than tasks, the exams are dealt, too.
    """
    # A tenth more than needed, as hashes do not spread evenly; one block is whole.
    blocks = 1 if many <= most else -(-10 * many // (9 * most))
    parts = max(1, min(exams, -(-2 * sheets.sparkSession.sparkContext.defaultParallelism // blocks)))
    block = F.pmod(F.xxhash64(*(c for c in sheets.columns if c != "times")), F.lit(blocks)).cast("int")
    dealt = sheets.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "*").repartitionById(blocks * parts, block * parts + F.col("part"))
    return dealt, blocks, parts


class _Code(NamedTuple):
    """How an answer of a plain sheet becomes one number of a view, whose sum over an exam tells its totals and what it lacks.

    Digits from the lowest: totals of the columns, the last first; answers that lack a column, for
    those that some answer lacks; questions without answer. No sum of ``largest`` answers carries over.
    """

    columns: list[str]
    weights: dict[str, int]  # of a step of a column's grade
    spans: dict[str, int]
    lacks: dict[str, int]  # of a missing grade
    whole: int  # less: nothing is missing
    absent: int  # of a question without answer


def _codes(plain: DataFrame, columns: Sequence[str], views: Sequence[Sequence[str]], sums: bool, largest: int) -> tuple[float, dict[str, int], list[_Code], str] | None:
    """(steps of a grade, least grade of each column in steps, a code for each view, type of its sums); None where sums of codes would not be exact."""
    grades, kinds = [f"t_{c}" for c in columns], "by double, " + ", ".join(f"`low_{c}` double, `high_{c}` double, `least_{c}` double" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns]
            t, v = flat[: len(columns)], flat[len(columns) :]
            found = {"by": _steps(t, 1)} | {f"{n}_{c}": f(x) for i, c in enumerate(columns) for n, f, x in (("low", np.min, t[i]), ("high", np.max, t[i]), ("least", np.min, v[i]))}
            yield pa.RecordBatch.from_arrays([pa.array([None if x is None else float(x)], pa.float64()) for x in found.values()], names=list(found))

    made = plain.select(*grades, *(f"v_{c}" for c in columns)).mapInArrow(run, kinds)
    of = made.agg(F.max("by").alias("by"), F.count_if(F.col("by").isNull()).alias("none"), *(f(f"{n}_{c}").alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max), ("least", F.min)))).first()
    if of["by"] is None or of["none"]:
        return None
    low = {c: int(of[f"low_{c}"] * of["by"]) for c in columns}
    codes = []
    for view in views:
        at, weights, spans, lacks = 1, {}, {}, {}
        for c in reversed(dict.fromkeys(view)) if sums else ():
            weights[c], spans[c] = at, largest * (int(of[f"high_{c}"] * of["by"]) - low[c]) + 1
            at *= spans[c]
        whole = at
        for c in dict.fromkeys(view):
            if of[f"least_{c}"] < 1:
                lacks[c] = at
                at *= largest + 1
        codes.append(_Code(list(view), weights, spans, lacks, whole, at))
    most = max(c.absent * (largest + 1) for c in codes)
    return None if most > 1 << 52 else (of["by"], low, codes, "float32" if most <= 1 << 24 else "float64")


def _coded(plain: DataFrame, columns: Sequence[str], coding: tuple, places: int) -> DataFrame:
    """(times, codes): a number for each view and place."""
    by, low, codes, kind = coding
    row_bytes = places * len(codes) * np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (32 << 20) // row_bytes)
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            lists = batch.column(1)
            number, rows = lists.flatten().to_numpy(), batch.num_rows
            row = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
            inside = number < places
            flat = {n: batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in batch.schema.names[2:]}
            laid = np.empty((rows, len(codes), places), kind)
            for i, code in enumerate(codes):
                value = np.zeros(len(number))
                for c, w in code.weights.items():
                    value += (flat[f"t_{c}"] * by - low[c]) * w
                for c, w in code.lacks.items():
                    value += (flat[f"v_{c}"] < 1) * float(w)
                laid[:, i] = code.absent
                laid[row[inside], i, number[inside]] = value[inside]
            ends = pa.py_buffer((np.arange(rows + 1) * row_bytes).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), rows, [None, ends, pa.py_buffer(laid)])], names=["times", "codes"])

    return plain.select("times", "number", *(f"{k}_{c}" for c in columns for k in ("v", "t"))).mapInArrow(run, "times double, codes binary")


def _counted_codes(dealt: DataFrame, parts: int, exams: list, coding: tuple, places: int, largest: int, wide: int) -> DataFrame:
    """``_counted`` for coded sheets: a sum of codes tells all about a sitting, so equal sums are counted."""
    by, low, codes, kind = coding
    row_bytes = places * len(codes) * np.dtype(kind).itemsize
    sent = dealt.sparkSession.sparkContext.broadcast([(np.array(x["numbers"], np.int64), x["test_size"]) for x in exams])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        dense = places * len(every) <= 32 * sum(z for _, z in every)
        for chunk in _chunks(batches, row_bytes):
            part, rows = chunk.column(0)[0].as_py(), chunk.num_rows
            exams = every[part::parts]
            times = chunk.column(1).to_numpy()
            times = None if (times == 1).all() else times
            # The codes lie one after another; a view's are turned so that a place is a row.
            bytes_of = chunk.column(2).combine_chunks().cast(pa.large_binary())
            start = int(np.frombuffer(bytes_of.buffers()[1], np.int64)[bytes_of.offset])
            flat = np.frombuffer(bytes_of.buffers()[2], kind, rows * row_bytes // np.dtype(kind).itemsize, start).reshape(rows, len(codes), places)
            laid = [np.ascontiguousarray(flat[:, i].T) for i in range(len(codes))]
            del flat, bytes_of
            step = max(1, 2_000_000 // rows)
            for first in range(0, len(exams), step):
                some, made = exams[first : first + step], []
                holds = np.zeros((len(some), places), kind)
                for i, (questions, _) in enumerate(some):
                    holds[i, questions] = 1
                for v, code in enumerate(codes):
                    summed = holds @ laid[v] if dense else np.stack([laid[v][questions].sum(axis=0) for questions, _ in some])
                    for i, (_, size) in enumerate(some):
                        place, value, stand = part + parts * (first + i), summed[i].astype(np.int64), times
                        if value.max() >= code.whole:
                            fits = value < code.whole
                            rest = ~fits & (value < code.absent)
                            status, lacking = np.zeros(int(rest.sum()), np.int64), value[rest]
                            for j, c in enumerate(code.columns):
                                if c in code.lacks:
                                    status |= (lacking // code.lacks[c] % (largest + 1) > 0).astype(np.int64) << j
                            kinds = np.bincount(status, None if times is None else times[rest], 1)
                            kind_at = np.flatnonzero(kinds)
                            if len(kind_at):
                                made.append((place, v, kind_at, None, kinds[kind_at]))
                            value, stand = value[fits], None if times is None else times[fits]
                        if not len(value):
                            continue
                        if code.whole <= 16 * rows + (1 << 16):
                            n = np.bincount(value, stand)
                            found = np.flatnonzero(n)
                            n = n[found]
                        else:
                            found, at = np.unique(value, return_inverse=True)
                            n = np.bincount(at.reshape(-1), stand, len(found))
                        totals = [(found // code.weights[c] % code.spans[c] + size * low[c]) / by for c in code.columns if c in code.weights]
                        made.append((place, v, np.zeros(len(n), np.int64), totals, n))
                yield from _made(made, wide)

    return dealt.mapInArrow(run, _made_kinds(wide))


def _made_kinds(wide: int) -> str:
    totals = "".join(f"t{i} double, " for i in range(wide))
    return f"exam int, view int, status int, {totals}n long"


def _made(made: list[tuple], wide: int) -> Iterator[pa.RecordBatch]:
    """Rows of counts (exam, view, status, t0, t1, .., n) of (exam, view, statuses, totals or None, numbers)."""
    if not made:
        return
    sizes = [len(m[4]) for m in made]
    arrays = [pa.array(np.repeat(np.array([m[k] for m in made], np.int32), sizes)) for k in (0, 1)] + [pa.array(np.concatenate([m[2] for m in made]).astype(np.int32))]
    for j in range(wide):
        none = np.concatenate([np.full(z, m[3] is None or j >= len(m[3])) for m, z in zip(made, sizes, strict=True)])
        arrays.append(pa.array(np.concatenate([np.zeros(z) if m[3] is None or j >= len(m[3]) else m[3][j] for m, z in zip(made, sizes, strict=True)]), mask=none))
    arrays.append(pa.array(np.concatenate([m[4] for m in made]).astype(np.int64)))
    whole = pa.RecordBatch.from_arrays(arrays, names=["exam", "view", "status", *(f"t{i}" for i in range(wide)), "n"])
    for i in range(0, whole.num_rows, 100_000):
        yield whole.slice(i, 100_000)


def _row_bytes(exams: list, columns: Sequence[str]) -> int:
    """Bytes of a laid-out sheet."""
    return (max(q for x in exams for q in x["numbers"]) + 1) * 8 * (3 + 2 * len(columns))


def _summed(chunk: pa.Table, exams: list[tuple], columns: Sequence[str], places: int, largest: int, dense: bool, sums: bool = True) -> Iterator[tuple[int, list, dict, float | None]]:
    """Sums of a table of sheets over exams (numbers of questions, size), some exams at a time.

    Place of the first, these exams, name -> a row of sums for each (``found``: questions answered), and
    by what totals are multiplied to be whole, if they can be. Sums do not depend on the other sheets.
    """
    names = ["n_rows", *(f"{k}_{c}" for c in columns for k in ("v", "t"))]
    rows, lists = chunk.num_rows, chunk.column("number").combine_chunks()
    number = lists.flatten().to_numpy()
    row = np.repeat(np.arange(rows), np.diff(lists.offsets.to_numpy()))
    inside = number < places
    where = (number[inside], row[inside])

    def lay(values: np.ndarray) -> np.ndarray:
        laid = np.zeros((places, rows))
        laid[where] = values[inside]
        return laid

    flat = {n: chunk.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in names}
    by = _steps([flat[f"t_{c}"] for c in columns], largest)
    laid = {n: lay(v * by if by and n[:2] == "t_" else v) for n, v in flat.items()} | {"found": lay(np.ones(len(number)))}
    step = max(1, 2_000_000 // rows)
    for first in range(0, len(exams), step):
        some = exams[first : first + step]
        if dense:
            holds = np.zeros((len(some), places))
            for i, (questions, _) in enumerate(some):
                holds[i, questions] = 1
        # Whole numbers add up alike in any order; other totals are added in the order of questions.
        exact = lambda n: dense and (by is not None or n[:2] != "t_")
        yield first, some, {n: holds @ v if exact(n) else np.stack([v[questions].sum(axis=0) for questions, _ in some]) for n, v in laid.items() if sums or n[:2] != "t_"}, by


def _counted(dealt: DataFrame, parts: int, exams: list, columns: Sequence[str], views: Sequence[Sequence[str]], sums: bool) -> DataFrame:
    """Counts (exam, view, status, t0, t1, .., n) over the sittings of some exams, a task's students in one.

    ``dealt``: a task has sheets of one ``part`` of the exams, those whose place leaves that rest.
    ``exam`` and ``view`` are places in the two lists. Bit i of ``status`` says that a grade in the
    view's column i is missing, the bit after the last that nothing else is wrong but that there are
    more rows than questions.
    Totals t0.. of the view's columns are null unless status is 0. Without ``sums`` there are none, and
    the last bit is set with the others, too.
    """
    row_bytes = _row_bytes(exams, columns)
    wide = max(map(len, views)) if sums else 0
    places = max(q for x in exams for q in x["numbers"]) + 1
    sent = dealt.sparkSession.sparkContext.broadcast([(np.array(x["numbers"], np.int64), x["test_size"]) for x in exams])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        largest, entries = max(z for _, z in every), sum(z for _, z in every)
        dense = places * len(every) <= 32 * entries
        for chunk in _chunks(batches, row_bytes):
            part = chunk.column(0)[0].as_py()
            times, rows = chunk.column(1).to_numpy(), chunk.num_rows
            for first, some, summed, by in _summed(chunk, every[part::parts], columns, places, largest, dense, sums):
                made: list[tuple] = []
                for i, (_, size) in enumerate(some):
                    sits = summed["found"][i] == size
                    more = summed["n_rows"][i] != size
                    lacks = {c: summed[f"v_{c}"][i] < size for c in columns}
                    codes: dict[str, tuple] = {}
                    for c in columns if sums else ():
                        total = summed[f"t_{c}"][i]
                        if by:
                            least = int(total.min())
                            codes[c] = (total.astype(np.int64) - least, int(total.max()) - least + 1, lambda k, least=least: (k + least) / by)
                        else:
                            values, code = np.unique(total, return_inverse=True)
                            codes[c] = (code.reshape(-1), len(values), lambda k, values=values: values[k])
                    for v, view in enumerate(views):
                        status = np.zeros(rows, np.int64)
                        for j, c in enumerate(view):
                            status |= lacks[c].astype(np.int64) << j
                        place = part + parts * (first + i)
                        if not sums:
                            kinds = np.bincount((status | more.astype(np.int64) << len(view))[sits], times[sits], 1)
                            kind = np.flatnonzero(kinds)
                            made.append((place, v, kind, None, kinds[kind]))
                            continue
                        status[more & (status == 0)] = 1 << len(view)
                        whole = sits & (status == 0)
                        code, span = np.zeros(rows, np.int64), 1
                        for c in view:
                            span *= codes[c][1]
                        if span < 1 << 62:
                            for c in view:
                                code = code * codes[c][1] + codes[c][0]
                            code, stand = (code, times) if whole.all() else (code[whole], times[whole])
                            if span <= 4 * rows + 4096:
                                n = np.bincount(code, stand, span)
                                found = np.flatnonzero(n)
                                n = n[found]
                            else:
                                found, at_code = np.unique(code, return_inverse=True)
                                n = np.bincount(at_code.reshape(-1), stand, len(found))
                            totals = []
                            for c in reversed(view):
                                totals.insert(0, codes[c][2](found % codes[c][1]))
                                found = found // codes[c][1]
                        else:
                            found, at_code = np.unique(np.stack([codes[c][0][whole] for c in view]), axis=1, return_inverse=True)
                            n = np.bincount(at_code.reshape(-1), times[whole], found.shape[1])
                            totals = [codes[c][2](found[j]) for j, c in enumerate(view)]
                        made.append((place, v, np.zeros(len(n), np.int64), totals, n))
                        if not whole.all():
                            kinds = np.bincount(status[sits & ~whole], times[sits & ~whole], 1)
                            kind = np.flatnonzero(kinds)
                            if len(kind):
                                made.append((place, v, kind, None, kinds[kind]))
                yield from _made(made, wide)

    return dealt.mapInArrow(run, _made_kinds(wide))


def sitting_counts(exam: DataFrame, answers: DataFrame, views: Mapping[str, Sequence[str]], sums: bool = True) -> DataFrame:
    """How many sittings (n) of a view and exam have the same totals t0, t1, .. in the view's columns.

    A view is a list of grade columns. ``lacks``: bit i is set where grades of column i are missing;
    ``more_rows``: none is missing, but there are more rows than questions; with either, totals are
    null. Without ``sums`` sittings are counted by what they lack alone, and ``more_rows`` may come with
    that. Equal sheets are counted first and students in the tasks, so no row is made for a sitting.
    """
    names, lists = list(views), [list(v) for v in views.values()]
    columns = sorted({c for v in lists for c in v})
    sheets, blocks = _in_blocks(exam, answers, columns)
    spark, wide = exam.sparkSession, max(map(len, lists)) if sums else 0
    totals = [f"t{i}" for i in range(wide)]
    many = F.element_at(F.lit([len(v) for v in lists]), F.col("view") + 1)
    parts = []
    different = _different(sheets if blocks else sheets.limit(0), columns)
    of = {r["plain"]: r["count"] for r in different.groupBy("plain").count().collect()}
    places, largest = 1 + max((q for some in blocks for x in some for q in x["numbers"]), default=0), max((x["test_size"] for some in blocks for x in some), default=1)
    plain = different.where("plain")
    coding = _codes(plain, columns, lists, sums, largest) if of.get(True) else None
    coded = None if coding is None else _coded(plain, columns, coding, places)
    # Sheets with several rows a question, or all where grades are no whole steps, are counted column by column.
    others = (different if coding is None else different.where("NOT plain")).drop("plain")
    left = sum(n for p, n in of.items() if coding is None or not p)
    for some in blocks or [[{"test_id": "", "test_size": 1, "numbers": [0]}]]:
        made, merge = [], False
        if coding is not None:
            dealt, of_sheets, of_exams = _dealt(coded, of[True], max(1, HELD // (places * len(lists) * np.dtype(coding[3]).itemsize)), len(some))
            made.append(_counted_codes(dealt, of_exams, some, coding, places, largest, wide))
            merge = of_sheets > 1
        if left or coding is None:
            dealt, of_sheets, of_exams = _dealt(others, left, max(1, HELD // _row_bytes(some, columns)), len(some))
            made.append(_counted(dealt, of_exams, some, columns, lists, sums))
            merge = merge or of_sheets > 1 or len(made) > 1
        counts = reduce(DataFrame.unionByName, made)
        if merge:
            counts = counts.groupBy("exam", "view", "status", *totals).agg(F.sum("n").alias("n"))
        known = spark.createDataFrame([(i, x["test_id"], x["test_size"]) for i, x in enumerate(some)], "exam int, test_id string, test_size int")
        parts.append(counts.join(F.broadcast(known), "exam"))
    every = reduce(DataFrame.unionByName, parts)
    # Bits above those of the view's columns: more rows than questions.
    return every.select(F.element_at(F.lit(names), F.col("view") + 1).alias("view"), *EXAM, (F.call_function("shiftright", F.col("status"), many) > 0).alias("more_rows"), F.col("status").bitwiseAND(F.call_function("shiftleft", F.lit(1), many) - 1).alias("lacks"), *totals, "n")


def eligible(sat: DataFrame) -> DataFrame:
    return sat.select(*EXAM, "member_id")


def sitting_totals(sat: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per exam-student: n_rows, n_questions, and per column v_ (valid grades) and t_ (total)."""
    return sat.select(*EXAM, "member_id", "n_rows", "n_questions", *(F.col(f"`{k}_{c}`") for c in columns for k in ("v", "t")))


#: A range of students has about so many, unless more ranges would be more than tasks.
IN_RANGE = 250


def _in_ranges(sheets: DataFrame) -> tuple[DataFrame, int]:
    """The sheets in ranges of students, written down in order, and how many ranges there are about."""
    sheets = settled(sheets, "sheets")
    parts = max(1, min(many_parts(sheets), -(-sheets.count() // IN_RANGE)))
    dealt = sheets.repartitionByRange(parts, "member_id").withColumn("range", F.spark_partition_id())
    return settled(dealt.sortWithinPartitions("member_id"), "ranges"), parts


def _alike(batches: Iterator[pa.RecordBatch], row_bytes: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of about ``HELD`` bytes, each with one range and as one kind: with or without student."""
    for chunk in _chunks(batches, row_bytes):
        kind = 2 * chunk.column("range").to_numpy() + chunk.column("member_id").is_null().to_numpy()
        ends = [*(np.flatnonzero(np.diff(kind)) + 1), chunk.num_rows]
        for start, end in zip([0, *ends], ends):  # noqa: B905
            yield chunk.slice(start, end - start)


def _whole(chunk: pa.Table, exams: list[tuple], columns: Sequence[str], views: Sequence[Sequence[str]], places: int, dense: bool) -> Iterator[tuple]:
    """For each exam and view (places in the lists) the students who are complete in the view's columns (rows of
    the table), the different totals of its last column in order, and which of them each student has."""
    for first, some, summed, by in _summed(chunk, exams, columns, places, max(z for _, z in exams), dense):
        for i, (_, size) in enumerate(some):
            sits = (summed["found"][i] == size) & (summed["n_rows"][i] == size)
            for v, view in enumerate(views):
                student = np.flatnonzero(np.logical_and.reduce([sits, *(summed[f"v_{c}"][i] == size for c in view)]))
                if not len(student):
                    continue
                total = summed[f"t_{view[-1]}"][i][student]
                if by:
                    least = int(total.min())
                    code = total.astype(np.int64) - least
                    seen = np.bincount(code) > 0
                    values, at = (np.flatnonzero(seen) + least) / by, (np.cumsum(seen) - 1)[code]
                else:
                    values, at = np.unique(total, return_inverse=True)
                yield first + i, v, student, values, at.reshape(-1)


def _range_counts(ranged: DataFrame, exams: list, columns: Sequence[str], views: Sequence[Sequence[str]]) -> DataFrame:
    """(range, exam, view, total, n) of the complete students of each range."""
    row_bytes, places = _row_bytes(exams, columns), max(q for x in exams for q in x["numbers"]) + 1
    sent = ranged.sparkSession.sparkContext.broadcast([(np.array(x["numbers"], np.int64), x["test_size"]) for x in exams])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        dense = places * len(every) <= 32 * sum(z for _, z in every)
        for chunk in _alike(batches, row_bytes):
            held, many, number = [], 0, chunk.column("range")[0].as_py()

            def out(held: list, number: int = number) -> pa.RecordBatch:
                sizes = [len(values) for _, _, values, _ in held]
                keys = [pa.array(np.repeat(np.array([h[k] for h in held], np.int32), sizes)) for k in (0, 1)]
                return pa.RecordBatch.from_arrays([pa.array(np.full(sum(sizes), number, np.int32)), *keys, pa.array(np.concatenate([h[2] for h in held])), pa.array(np.concatenate([h[3] for h in held]))], names=["range", "exam", "view", "total", "n"])

            for place, v, _, values, at in _whole(chunk, every, columns, views, places, dense):
                held.append((place, v, values, np.bincount(at)))
                many += len(values)
                if many > 100_000:
                    yield out(held)
                    held, many = [], 0
            if held:
                yield out(held)

    return ranged.mapInArrow(run, "range int, exam int, view int, total double, n long").groupBy("range", "exam", "view", "total").agg(F.sum("n").alias("n"))


def _placed(ranged: DataFrame, parts: int, ahead: DataFrame, exams: list, columns: Sequence[str], views: Sequence[Sequence[str]]) -> DataFrame:
    """(exam, view, member_id, total, rank) of the complete students.

    ``ahead``: a row for each range, exam and view with the totals in order and how many students are
    ahead of the range's first with each. A task has a range's rows of it, then its students in order.
    """
    row_bytes, places = _row_bytes(exams, columns), max(q for x in exams for q in x["numbers"]) + 1
    sent = ranged.sparkSession.sparkContext.broadcast([(np.array(x["numbers"], np.int64), x["test_size"]) for x in exams])
    kind = ranged.schema["member_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sent.value
        dense = places * len(every) <= 32 * sum(z for _, z in every)
        known: dict[tuple, tuple] = {}
        now = None
        for chunk in _alike(batches, row_bytes):
            if now != (now := chunk.column("range")[0].as_py()):
                known = {}
            members = chunk.column("member_id").combine_chunks()
            if members.null_count:
                lists = [chunk.column(c).combine_chunks() for c in ("totals", "before")]
                ends = np.cumsum(np.diff(lists[0].offsets.to_numpy()))[:-1]
                of = (np.split(x.flatten().to_numpy().copy(), ends) for x in lists)
                known |= dict(zip(zip(*(chunk.column(c).to_pylist() for c in ("exam", "view")), strict=True), zip(*of, strict=True), strict=True))
                continue
            held, many = [], 0

            def out(held: list, members: pa.Array = members) -> pa.RecordBatch:
                sizes = [len(student) for _, _, student, _, _ in held]
                keys = [pa.array(np.repeat(np.array([h[k] for h in held], np.int32), sizes)) for k in (0, 1)]
                student, total, rank = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
                return pa.RecordBatch.from_arrays([*keys, members.take(pa.array(student)), pa.array(total), pa.array(rank.astype(np.int32))], names=["exam", "view", "member_id", "total", "rank"])

            for place, v, student, values, at in _whole(chunk, every, columns, views, places, dense):
                totals, before = known[place, v]
                where, n = np.searchsorted(totals, values), np.bincount(at)
                # Students of equal totals one after another, in their order.
                order = np.argsort(at.astype(np.uint16) if len(values) < 1 << 16 else at, kind="stable")
                rank = np.empty(len(at), np.int64)
                rank[order] = np.arange(1, len(at) + 1) + np.repeat(before[where] - (np.cumsum(n) - n), n)
                before[where] += n
                held.append((place, v, student, values[at], rank))
                many += len(at)
                if many > 50_000:
                    yield out(held)
                    held, many = [], 0
            if held:
                yield out(held)

    rows = ranged.unionByName(ahead, allowMissingColumns=True)
    # Without student first.
    dealt = rows.repartitionById(parts, F.pmod("range", F.lit(parts))).sortWithinPartitions("range", F.asc_nulls_first("member_id"))
    return dealt.mapInArrow(run, f"exam int, view int, member_id {kind}, total double, rank int")


def sitting_ranks(exam: DataFrame, answers: DataFrame, views: Mapping[str, Sequence[str]]) -> DataFrame:
    """(view, exam, member_id, total, rank) of the sittings that are complete in a view's columns, by the total
    of its last column from the highest, ties by student.

    Sheets are kept in ranges of students. Ranges count their totals; sums of these counts tell how many are ahead
    of each range's first student, and its task numbers the others, so no row of a sitting is moved.
    """
    names, lists = list(views), [list(v) for v in views.values()]
    columns = sorted({c for v in lists for c in v})
    sheets, blocks = _in_blocks(exam, answers, columns)
    ranged, ranges = _in_ranges(sheets if blocks else sheets.limit(0))
    higher = Window.partitionBy("exam", "view").orderBy(F.desc("total"), "range")
    parts = []
    for some in blocks or [[{"test_id": "", "test_size": 1, "numbers": [0]}]]:
        counts = _range_counts(ranged, some, columns, lists)
        ahead = counts.withColumn("_before", F.sum("n").over(higher) - F.col("n"))
        ahead = ahead.groupBy("range", "exam", "view").agg(F.sort_array(F.collect_list(F.struct("total", "_before"))).alias("_t")).select("range", "exam", "view", F.col("_t.total").alias("totals"), F.col("_t._before").alias("before"))
        known = exam.sparkSession.createDataFrame([(i, x["test_id"], x["test_size"]) for i, x in enumerate(some)], "exam int, test_id string, test_size int")
        parts.append(_placed(ranged, ranges, ahead, some, columns, lists).join(F.broadcast(known), "exam"))
    return reduce(DataFrame.unionByName, parts).select(F.element_at(F.lit(names), F.col("view") + 1).alias("view"), *EXAM, "member_id", "total", "rank")
