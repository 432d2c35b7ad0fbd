"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A line ends at a line break or after a sentence's end (. ! ? and a space), so passages that were pasted into a
paragraph are lines too; lines joined give the text back to the letter. Lines are compared, and their characters counted,
without blanks around them, each with one more character for its end. A run of lines with at least `min_run` characters
is deleted wherever the same lines in a row also stand at an earlier place (least id, then text hash, then position);
every such run goes, and every distinct line's first place stays.

* Windows: from each line on, the fewest lines with `min_run` characters. A window's least line hash (lines of LONG_LINE
  characters go first) is its fingerprint, so equal windows have equal fingerprints: every repeated run is guaranteed one.
* Positions are joined on their fingerprints' counts: a window whose fingerprint stands at one place only can't be
  repeated and goes no further. There are no pairs of places.
* Of the others, all lines of the window are compared, by their hash, with the windows at other places. Matches extend both
  ways by the windows that follow each other: a run is the union of its repeated windows, and what it has beyond its last
  window, less than a window, is compared as tails of that window, only where the window is repeated.

Hashes have 64 bits; with n different windows two share a hash with a chance of n^2 / 2^65.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithspark.llm.common import cut, join_counted

#: Windows of up to this many lines are found by a chain of cases; longer ones line by line.
FAST_LINES = 8
#: Lines of so many characters are taken as fingerprints before shorter ones, which are often common.
LONG_LINE = 30
#: Runs to delete are broadcast up to this many, some 40 bytes each; more are joined by a shuffle of the texts.
BROADCAST_RUNS = 300_000


def lines_of(text: F.Column) -> F.Column:
    """The text cut after line breaks and sentence ends; nothing is lost. One pass of plain replacements, unless the
    text holds the mark itself."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + "\x01"))
    return F.when(F.instr(text, "\x01") > 0, F.split(text, r"(?<=\n)|(?<=[.!?] )")).otherwise(F.split(marked, "\x01"))


def _with_windows(docs: DataFrame, id_col: str, text_col: str, min_run: int) -> DataFrame:
    """id, th, prints: of each fingerprint's place, f (its line's hash) and windows, those that chose it: g (hash of all
    lines), pos (first line), n (lines), and tails: hashes of the window's lines and 1, 2, ... lines after it, as far as the
    lines after the first have under min_run characters. Lines from which on the text has no window are in no window of
    their own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.transform(lines_of(text), lambda x: F.btrim(x, F.lit(" \t\r\n"))).alias("lines"))
    rows = rows.select("id", "th", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.length(x) + 1).alias("lengths"))
    total = "get(lengths, i - 1)"
    cases = []
    for n in range(1, FAST_LINES + 1):
        cases.append(f"when {total} >= {min_run} then {n}")
        total += f" + get(lengths, i + {n - 1})"
    # every line has a character at least, so min_run lines are enough; most windows have far fewer, so these are tried first.
    # The state is one number: lines above, characters, which stay under twice min_run, below
    bits = (2 * min_run).bit_length()
    count = f"(a & {(1 << bits) - 1}L) >= {min_run}"
    step = f"0L, (a, x) -> if({count}, a, a + {1 << bits}L + least(x, {min_run})), a -> if({count}, cast(shiftright(a, {bits}) as int), null)"
    longer = f"coalesce(aggregate(slice(lengths, i, {4 * FAST_LINES}), {step}), aggregate(slice(lengths, i, {min_run}), {step}))"
    rows = rows.withColumn("sizes", F.expr(f"transform(sequence(1, size(lengths)), i -> case {' '.join(cases)} else {longer} end)"))
    # what lines are ordered by: long ones first (the sign), then 39 bits of the hash, then the place among the lines
    order = f"transform(hashes, (h, i) -> (h & {(1 << 63) - (1 << 24)}L) | (i & {(1 << 24) - 1}) | if(get(lengths, i) >= {LONG_LINE}, -9223372036854775807L - 1L, 0L))"
    rows = rows.withColumn("order", F.expr(order))
    rows = rows.withColumn("least", F.expr("transform(filter(sizes, n -> n is not null), (n, i) -> array_min(slice(order, i + 1, n)))"))
    tails = "if(n < coalesce(get(sizes, i + 1), size(sizes) - i), transform(sequence(n + 1, coalesce(get(sizes, i + 1), size(sizes) - i)), m -> xxhash64(slice(hashes, i + 1, m))), array())"
    rows = rows.withColumn("windows", F.expr(f"transform(slice(sizes, 1, size(least)), (n, i) -> struct(xxhash64(slice(hashes, i + 1, n)) as g, i + 1 as pos, n, {tails} as tails))"))
    rows = rows.withColumn("starts", F.expr("filter(transform(least, (x, i) -> if(i = 0 or x <> get(least, i - 1), i, null)), i -> i is not null)"))
    place = f"s + cast(pmod((get(least, s) & {(1 << 24) - 1}L) - s, {1 << 24}L) as int)"
    rows = rows.withColumn("prints", F.expr(f"transform(starts, (s, j) -> struct(get(hashes, {place}) as f, slice(windows, s + 1, coalesce(get(starts, j + 1), size(windows)) - s) as windows))"))
    return rows.select("id", "th", "prints")


def _later(places: DataFrame, key: str) -> DataFrame:
    """The places (id, th, pos and more) whose key stands at several places, with later: whether it isn't the first."""
    place = F.struct("id", "th", "pos")
    firsts = cut(places.groupBy(key).agg(F.min(place).alias("first"), F.count("*").alias("places")).filter("places > 1"), merge=32)
    return join_counted(places, firsts, key, "places").withColumn("later", ~place.eqNullSafe(F.col("first"))).drop("first")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 120) -> DataFrame:
    """Per document with later copies of runs: id, th (hash of its text), runs (array of first and last line, from 1)."""
    rows = cut(_with_windows(docs, id_col, text_col, min_run))
    shared = cut(rows.select(F.explode("prints.f").alias("f")).groupBy("f").agg(F.count("*").alias("n")).filter("n > 1"), merge=32)
    near = cut(join_counted(rows.select("id", "th", F.inline("prints")), shared, "f").select("id", "th", F.inline("windows")), merge=4)
    met = cut(_later(near, "g"), merge=4)
    runs = met.filter("later").select("id", "th", F.col("pos").alias("lo"), (F.col("pos") + F.col("n") - 1).alias("hi"))
    tails = met.select("id", "th", "pos", "n", F.posexplode("tails").alias("k", "h"))
    last = F.col("pos") + F.col("n") + F.col("k")
    ends = _later(tails, "h").filter("later").select("id", "th", last.alias("lo"), last.alias("hi"))
    lines = F.flatten(F.collect_set(F.sequence("lo", "hi")))
    lines = runs.unionByName(ends).groupBy("id", "th").agg(F.sort_array(F.array_distinct(lines)).alias("lines"))
    lo = F.expr("filter(lines, (x, i) -> i = 0 or get(lines, i - 1) < x - 1)")
    hi = F.expr("filter(lines, (x, i) -> i = size(lines) - 1 or get(lines, i + 1) > x + 1)")
    return lines.select("id", "th", lo.alias("lo"), hi.alias("hi")).select("id", "th", F.arrays_zip("lo", "hi").alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 120, counts: bool | str = False) -> DataFrame:
    """docs with the later copies of repeated runs of lines cut out of text_col; the columns of docs.

    With counts also n_removed (or the name given), the lines cut out; a column of docs of that name gives way to it. Documents without such
    runs keep their text to the letter; a text that is a later copy as a whole becomes "". Null stays null. Rows with the
    same id and text are one document, which keeps what is its own in each row; a null id comes before all others. Other
    columns may bear any name. An empty table gives no rows.
    """
    runs = cut(repeated_runs(docs, id_col, text_col, min_run), merge=32).select(F.col("id").alias("run_id"), F.col("th").alias("run_th"), "runs")
    if (runs.agg(F.sum(F.size("runs"))).first()[0] or 0) <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    made = "n_removed" if counts is True else counts
    kept = [c for c in docs.columns if c != made]
    name = {c: f"c{i}" for i, c in enumerate(kept)}
    rows = docs.select(*[docs[c].alias(name[c]) for c in kept])
    text = F.coalesce(F.col(name[text_col]), F.lit(""))
    rows = rows.withColumn("th", F.xxhash64(text))
    rows = rows.join(runs, F.col(name[id_col]).eqNullSafe(F.col("run_id")) & (F.col("th") == F.col("run_th")), "left")
    rows = rows.withColumn("gone", F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["lo"], r["hi"])))))

    def without(lines):  # lines is bound once per row, wherever Catalyst moves the expression
        left = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.col("gone"))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i - 1)), "")

    own = F.col(name[text_col])
    clean = F.when(F.col("runs").isNull(), own).otherwise(F.get(F.transform(F.array(lines_of(text)), without), F.lit(0)))
    out = [(clean if c == text_col else F.col(name[c])).alias(c) for c in kept]
    if made:
        out.append(F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias(made))
    return rows.select(*out)
