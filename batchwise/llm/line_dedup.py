"""Operator 6, line dedup: exact lines by hash, near lines by a deletion-neighbourhood join.

A line is the text between two line feeds; its form is its words (runs without
ASCII white space) joined by single spaces.  Two lines are alike when at most
one word was inserted, deleted or replaced between them (word edit distance 1
or less).  A line goes when any line that comes earlier, by (id, line number),
is alike.  Shorter lines than ``min_words`` words go as exact repeats only, and
those shorter than ``exact_words`` (lines without a word) always stay.  With
``edit_every`` lines are alike up to one edit for each so many words of the
longer line (at least one).

How: (1) equal forms are grouped by two 64-bit hashes, the earliest occurrence
stands for the form.  (2) Of two forms at distance 1 one half must be equal, so
only forms that share a half with another go on: an exact test that spares most
lines the next step.  (3) Each such form emits its deletion neighbourhood as
hashed keys: the form without its word i (where two forms differ in one word,
these are equal) and, for forms that differ by one word more, the same as a gap
in the shorter form.  (4) Equal keys
are joined, each row with the earliest member of its key only, so a template
that thousands of lines share makes thousands of rows and not their square.
(5) The edit distance of each pair is verified on the words.
(6) For more edits than one an equal key proves nothing.  An edit changes at most
GRAM runs of GRAM words, so of two forms within k edits each has a common run
among its first k * GRAM + 1 in any order that is the same for all forms; this
holds too where a form has fewer runs, as a pair within the bound shares one.
Runs found often in a sample come last, so that a passage many lines share
brings lines together only if little else is in them.  Each form is compared with
the earliest of its keys first and, unless alike, with all the others.
(7) A document of which as many lines stay as count is untouched: a bounded filter
lets it pass, and only the others meet the numbers of their lines by shuffle.

Defined cases: a null text stays null, an empty one empty; a text of any length is
read in its whole, a row a line.  Ids order by value,
null last; rows with the same id and text are one document here and are treated
alike.  An empty table gives an empty result.  All input columns are returned;
those named like the added ones (text, n_lines, n_exact, n_near, emptied) are
replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize, release
from .bloom import filter_of, filter_words, only_repeated, probe, repeated_keys
from .common import SPACE_CLASS, join_groups

MIN_WORDS = 5
ADDED = ("n_lines", "n_exact", "n_near", "emptied")
POSITION = ("no_id", "id", "rid", "line_no")
# Words of a run in the search for more than one edit; from LEAST_EVERY on a pair within the bound shares a run.
GRAM, LEAST_EVERY = 6, 10
# Runs that come last in the order: at most so many, found in so many lines of one document in SAMPLE.
HOT_RUNS, HOT_LINES, SAMPLE = 500, 4, 16


def _has_words(line: Column, n: int) -> Column:
    word, space = r"[^\x20\x09-\x0D]+", f"{SPACE_CLASS}+"
    return line.rlike(rf"\A{SPACE_CLASS}*(?:{word}{space}){{{n - 1}}}{word}" if n > 1 else word)


def _form(line: Column) -> Column:
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for space in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(line, F.lit(space))
    return F.when(odd, F.trim(F.regexp_replace(line, f"{SPACE_CLASS}+", " "))).otherwise(line)


def _n_words(form: Column) -> Column:
    return (F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit(""))) + 1).cast("int")


def _first(form: Column, n: Column) -> Column:
    return F.call_function("substring_index", form, F.lit(" "), n.cast("int"))


def _last(form: Column, n: Column) -> Column:
    return F.call_function("substring_index", form, F.lit(" "), -n.cast("int"))


def _half_keys(form: Column, n: Column) -> Column:
    """Two keys as the shorter (or equal) line of a pair and two as the longer one."""
    keys = []
    for base in (n, n - 1):
        half = F.floor(base / 2)
        keys += [F.xxhash64(base, F.lit("first"), _first(form, half)),
                 F.xxhash64(base, F.lit("last"), _last(form, base - half))]
    return F.array(*keys)


def alike(a: Column, b: Column) -> Column:
    """True if the word edit distance of two forms is at most 1."""
    a, b = F.split(a, " "), F.split(b, " ")
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    n, m = F.size(short), F.size(long)
    # words equal from the left, then the rest with the differing word left out
    p = F.array_position(F.zip_with(short, F.slice(long, 1, n), lambda x, y: x == y), False).cast("int")
    p = F.when(p == 0, n).otherwise(p - 1)
    replaced = F.slice(short, p + 2, n) == F.slice(long, p + 2, n)
    inserted = F.slice(short, p + 1, m) == F.slice(long, p + 2, m)
    return F.when(n == m, replaced).when(m == n + 1, inserted).otherwise(False)


def within(a: Column, b: Column, k: Column) -> Column:
    """True if the word edit distance of two forms is at most k: each word becomes one character of its own."""
    a, b, k = F.split(a, " "), F.split(b, " "), k.cast("int")

    def characters(words: Column, known: Column) -> Column:
        code = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0"))
        return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")

    both = F.struct(a.alias("a"), b.alias("b"), F.array_union(a, b).alias("known"))
    verified = _once(both, lambda s: F.call_function(
        "levenshtein", characters(s["a"], s["known"]), characters(s["b"], s["known"]), k) >= 0)
    # each word that the other form lacks takes an edit
    lacking = F.greatest(F.size(F.array_except(a, b)), F.size(F.array_except(b, a)))
    return F.when(lacking > k, False).otherwise(verified)


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), text.alias("t"),
                       F.xxhash64(F.col(id_col), text).alias("rid"))
    return (rows.select("no_id", "id", "rid", F.posexplode(F.split("t", "\n")).alias("line_no", "line"))
            .where(_has_words(F.col("line"), min_words)))


def near_forms(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """The forms (h1, h2 and position) that have an earlier form at word edit distance 1."""
    # forms that share a half with another form
    halves = forms.select("h1", "h2", *POSITION, F.explode("halves").alias("half"))
    often = repeated_keys(halves, "half")
    some = materialize(only_repeated(halves, "half", often).select("h1", "h2", *POSITION).dropDuplicates(["h1", "h2"]),
                       "line-candidates")
    # their words: the text is read again, and a bounded filter keeps all but the wanted positions where they are
    words = filter_words(some.count())
    place = F.xxhash64("rid", "line_no")
    texts = probe(lines, place, filter_of(some, place, words), words, 3).where("_maybe")
    texts = (texts.select("rid", "line_no", _form(F.col("line")).alias("form"))
             .withColumns({"h1": F.xxhash64("form"), "h2": F.xxhash64("form", F.lit(2))})
             .join(some, ["h1", "h2", "rid", "line_no"]).dropDuplicates(["h1", "h2"])
             .select(F.monotonically_increasing_id().alias("no"), "h1", "h2", F.struct(*POSITION).alias("pos"), "form",
                     F.size(F.split("form", " ")).alias("n")))
    texts = materialize(texts, "line-texts")
    places = texts.select("no", "pos")
    release(often, some)

    keys = materialize(neighbourhood(texts), "line-keys")
    often = repeated_keys(keys, "key")
    meet = materialize(only_repeated(keys, "key", often).join(places, "no"), "line-meet")
    release(keys, often)
    longer = F.col("role") == "longer"
    entry = F.struct("pos", "no")
    groups = meet.groupBy("key", "check").agg(
        F.count(F.lit(1)).alias("members"), F.min(F.when(~longer, entry)).alias("lead"),
        F.min(F.when(longer, entry)).alias("lead_longer")).where("members > 1")
    groups = materialize(groups, "line-groups")
    pairs = join_groups(meet, groups, ["key", "check"], "members", meet.count())
    # a replaced word meets replaced ones, a shorter line meets longer ones, and the other way round
    lead = F.when(F.col("role") == "shorter", F.col("lead_longer")).otherwise(F.col("lead"))
    pairs = materialize(pairs.withColumn("lead", lead).where("lead.pos < pos")
                        .select("no", F.col("lead.no").alias("lead")).distinct(), "line-pairs")
    # the earliest member of a key may lead many lines: its form is joined by its number of pairs
    leads = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("led"))
    leads = materialize(leads.join(texts.select(F.col("no").alias("lead"), F.col("form").alias("lead_form")), "lead"),
                        "line-leads")
    found = join_groups(pairs, leads, ["lead"], "led", pairs.count()).join(texts, "no")
    found = found.where(alike(F.col("form"), F.col("lead_form"))).select("h1", "h2", "pos.*").dropDuplicates(["h1", "h2"])
    found = materialize(found, "line-near")
    release(texts, meet, groups, pairs, leads)
    return found


def neighbourhood(texts: DataFrame) -> DataFrame:
    """The deletion neighbourhood of each form: rows (no, role, key, check), in time linear in the words.

    A variant is the words before a place and the words after it.  Both are
    hashed as exclusive or over words with their places (from the left, from the
    right), so running ones give every variant of a form in one pass; ``check``
    is a second hash, independent of ``key``.
    """
    # forms move, not their words' hashes
    words = texts.repartition("no").select("no", "n", F.posexplode(F.split("form", " ")).alias("i", "w"))
    seeds = (1, 2)
    words = words.select("no", "n", "i", *[c for s in seeds for c in (
        F.xxhash64("w", "i", F.lit(s)).alias(f"left{s}"),
        F.xxhash64("w", F.col("i") - F.col("n"), F.lit(s)).alias(f"right{s}"))])
    line = Window.partitionBy("no")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = words.withColumns({k: v for s in seeds for k, v in (
        (f"lefts{s}", F.bit_xor(f"left{s}").over(upto)), (f"all_right{s}", F.bit_xor(f"right{s}").over(line)),
        (f"rights{s}", F.bit_xor(f"right{s}").over(upto)))})
    left = [F.col(f"lefts{s}").bitwiseXOR(F.col(f"left{s}")) for s in seeds]
    right = [F.col(f"all_right{s}").bitwiseXOR(F.col(f"rights{s}")) for s in seeds]
    own_right = [r.bitwiseXOR(F.col(f"right{s}")) for r, s in zip(right, seeds, strict=True)]

    def variant(role: str, kind: str, n: Column, i: Column, before: list[Column], after: list[Column]) -> Column:
        return F.struct(F.lit(role).alias("role"), F.xxhash64(F.lit(kind), n, i, before[0], after[0]).alias("key"),
                        F.hash(F.lit(kind), n, i, before[1], after[1]).alias("check"))

    n, i = F.col("n"), F.col("i")
    kinds = [variant("replaced", "word", n, i, left, right), variant("longer", "gap", n - 1, i, left, right),
             variant("shorter", "gap", n, i, left, own_right)]
    end = variant("shorter", "gap", n, n, [F.col(f"lefts{s}") for s in seeds], [F.lit(0).cast("long")] * 2)
    return sums.select("no", F.explode(F.when(i == n - 1, F.array(*kinds, end)).otherwise(F.array(*kinds))).alias("k")).select(
        "no", "k.role", "k.key", "k.check")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, not for each place that names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(form: Column) -> Column:
    """The distinct runs of GRAM words of a form, as hashes."""
    words = F.transform(F.split(form, " "), lambda w: F.xxhash64(w))
    return _once(words, lambda ws: F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(ws) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(ws, i, GRAM)))))


def far_forms(lines: DataFrame, forms: DataFrame, near: DataFrame, edit_every: int) -> DataFrame:
    """The forms (h1, h2 and position) not in ``near`` that have an earlier form within more edits than one."""
    form, least = F.col("form"), 2 * (edit_every - 1)
    wide = lines.where(F.length("line") >= 2 * least - 1).select(*POSITION, _form(F.col("line")).alias("form"))
    wide = wide.withColumn("n", _n_words(form)).where(F.col("n") >= least)
    often = (wide.where(F.pmod("rid", F.lit(SAMPLE)) == 0).select(F.explode(_runs(form)).alias("run"))
             .groupBy("run").agg(F.count(F.lit(1)).alias("found")).where(F.col("found") >= HOT_LINES))
    # at most HOT_RUNS numbers reach the driver
    hot = [r["run"] for r in often.orderBy(F.col("found").desc(), "run").limit(HOT_RUNS).collect()]

    # a partner is longer by k at most, so k edits need n + k >= edit_every * k words
    most = F.floor(F.col("n") / (edit_every - 1)).cast("int")
    last = F.lit(hot).cast("array<long>") if hot else F.array().cast("array<long>")
    keys = _once(_runs(form), lambda r: F.slice(F.concat(
        F.sort_array(F.array_except(r, last)), F.sort_array(F.array_intersect(r, last))), 1, most * GRAM + 1))
    far = wide.select("rid", "line_no", F.xxhash64("form").alias("h1"), F.xxhash64("form", F.lit(2)).alias("h2"), "n",
                      keys.alias("keys"))
    far = far.join(forms.select("h1", "h2", *POSITION), ["h1", "h2", "rid", "line_no"]).dropDuplicates(["h1", "h2"])
    far = materialize(far.select(F.monotonically_increasing_id().alias("no"), "h1", "h2",
                                 F.struct(*POSITION).alias("pos"), "n", "keys"), "line-far")
    places = far.select("no", "pos", "n")
    keys = materialize(far.select("no", F.explode("keys").alias("key")), "line-far-keys")
    meet = materialize(only_repeated(keys, "key").join(places, "no"), "line-far-meet")
    met = materialize(far.join(meet.select("no").distinct(), "no").select("no", "h1", "h2", "pos.*", "n"), "line-far-met")

    # the words of the forms that meet another
    size = filter_words(met.count())
    place = F.xxhash64("rid", "line_no")
    texts = probe(lines, place, filter_of(met, place, size), size, 3).where("_maybe")
    texts = (texts.select("rid", "line_no", _form(F.col("line")).alias("form"))
             .withColumns({"h1": F.xxhash64("form"), "h2": F.xxhash64("form", F.lit(2))})
             .join(met.select("no", "h1", "h2", "rid", "line_no"), ["h1", "h2", "rid", "line_no"])
             .dropDuplicates(["no"]).select("no", "form"))
    texts = materialize(texts, "line-far-texts")

    bound = F.floor(F.greatest("n", "lead_n") / edit_every)
    close = F.abs(F.col("n") - F.col("lead_n")) <= bound

    def alike_ones(pairs: DataFrame, name: str) -> DataFrame:
        """The numbers of the later forms of the pairs (no, n, lead, lead_n) that are alike."""
        pairs = materialize(pairs.where(close).distinct(), f"line-{name}-pairs")
        leads = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("led"))
        leads = materialize(leads.join(texts.select(F.col("no").alias("lead"), F.col("form").alias("lead_form")), "lead"),
                            f"line-{name}-leads")
        pairs = join_groups(pairs, leads, ["lead"], "led", pairs.count()).join(texts, "no")
        return materialize(pairs.where(within(form, F.col("lead_form"), bound)).select("no").distinct(), f"line-{name}")

    groups = meet.groupBy("key").agg(F.count(F.lit(1)).alias("members"),
                                     F.min(F.struct("pos", "no", "n")).alias("lead")).where("members > 1")
    groups = materialize(groups, "line-far-groups")
    known = materialize(met.join(near.select("h1", "h2"), ["h1", "h2"]).select("no"), "line-far-known")
    open_ = meet.join(known, "no", "left_anti")
    led = join_groups(open_, groups, ["key"], "members", meet.count()).where("lead.pos < pos")
    first = alike_ones(led.select("no", "n", F.col("lead.no").alias("lead"), F.col("lead.n").alias("lead_n")), "first")
    earlier = meet.select("key", F.col("no").alias("lead"), F.col("n").alias("lead_n"), F.col("pos").alias("lead_pos"))
    rest = open_.join(first, "no", "left_anti").join(earlier, "key").where("lead_pos < pos")
    other = alike_ones(rest.select("no", "n", "lead", "lead_n"), "other")
    return met.join(first.unionByName(other), "no").select("h1", "h2", *POSITION)


def _marks(table: DataFrame, forms: DataFrame, near: DataFrame) -> DataFrame:
    """_id, _rid and the numbers of the first and near lines of each document that loses a line.

    A form has one earliest position, so a document gathers its own line numbers only.
    """
    place, number = ("no_id", "id", "rid"), F.lit(None).cast("int")
    counted = table.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.select(*place, "n", number.alias("first"), number.alias("near"))
    for lines, kind in ((forms, "first"), (near, "near")):
        rows = rows.unionByName(lines.select(*place, F.lit(0).cast("long").alias("n"), *[
            (F.col("line_no") if kind == k else number).alias(k) for k in ("first", "near")]))
    marks = rows.groupBy(*place).agg(F.sum("n").alias("n"), F.collect_list("first").alias("firsts"),
                                     F.collect_list("near").alias("nears"))
    return marks.where(F.col("n") > F.size("firsts") - F.size("nears")).select(
        F.col("id").alias("_id"), F.col("rid").alias("_rid"), "firsts", "nears")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
               exact_words: int = 1, edit_every: int | None = None) -> DataFrame:
    """The input with the text of the lines that stay, and ADDED.

    n_lines: lines before; n_exact, n_near: lines that went as equal or near
    ones; emptied: some line went and no word is left.  ``exact_words``: the
    least words of a line that goes as an equal one.
    ``edit_every``: words of the longer line for each edit (one edit if not given).
    """
    if edit_every is not None and edit_every < LEAST_EVERY:
        raise ValueError(f"edit_every must be at least {LEAST_EVERY}")
    exact_words = min(exact_words, min_words)
    lines = _lines(docs, id_col, text_col, exact_words)
    form = F.col("form")
    n = _n_words(form)
    halves = _half_keys(form, n)
    if exact_words < min_words:
        # cut, not chosen: in the branch of a condition the form would be worked out again for each use
        halves = F.slice(halves, F.lit(1), F.when(n >= min_words, F.lit(4)).otherwise(F.lit(0)))
    table = materialize(
        lines.withColumn("form", _form(F.col("line")))
        .select(*POSITION, F.xxhash64("form").alias("h1"), F.xxhash64("form", F.lit(2)).alias("h2"),
                halves.alias("halves")), "lines")
    forms = table.groupBy("h1", "h2").agg(
        F.min(F.struct(*POSITION)).alias("pos"), F.first("halves").alias("halves"))
    forms = materialize(forms.select("h1", "h2", "pos.*", "halves"), "line-forms")
    wide = _lines(docs, id_col, text_col, min_words)
    near = near_forms(wide, forms)
    if edit_every is not None:
        near = materialize(near.unionByName(far_forms(wide, forms, near, edit_every)), "line-all-near")
    marks = materialize(_marks(table, forms, near), "line-marks")
    release(table, forms, near)

    others = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(id_col).alias("id"),
                       F.col(text_col).cast("string").alias("t"))
    rows = rows.withColumn("rid", F.xxhash64("id", "t"))
    # a document whose lines all stay is not shuffled
    size = filter_words(marks.count())
    probed = probe(rows, F.col("rid"), filter_of(marks, F.col("_rid"), size), size, 3)
    lone, none = F.array().cast("array<int>"), F.lit(0).cast("long")
    untouched = probed.where("not _maybe").select(
        "row", F.col("t").alias("_text"),
        F.when(F.col("t").isNull(), none).otherwise(F.size(F.split("t", "\n"))).cast("long").alias("n_lines"),
        none.alias("n_exact"), none.alias("n_near"), F.lit(False).alias("emptied"))

    joined = probed.where("_maybe").join(
        marks, (F.col("rid") == F.col("_rid")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    numbered = F.transform(F.split("t", "\n"), lambda x, i: F.struct(
        x.alias("line"), i.alias("i"), _has_words(x, exact_words).alias("counted")))
    stays = F.filter("_lines", lambda s: F.col("_rid").isNull() | ~s["counted"] | (
        F.array_contains(F.col("_firsts"), s["i"]) & ~F.array_contains(F.col("_nears"), s["i"])))
    joined = joined.withColumns({"_lines": numbered, "_firsts": F.coalesce("firsts", lone),
                                 "_nears": F.coalesce("nears", lone)}).withColumn("_stay", stays)
    gone = F.size("_lines") - F.size("_stay")
    joined = joined.withColumns({
        "_text": F.when(F.col("t").isNull(), F.lit(None)).when(gone == 0, F.col("t")).otherwise(
            F.array_join(F.transform("_stay", lambda s: s["line"]), "\n")),
        "n_lines": F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long"),
        "n_near": F.size("_nears").cast("long"),
        "_gone": F.when(F.col("t").isNull(), F.lit(0)).otherwise(gone).cast("long")})
    joined = joined.withColumns({
        "n_exact": F.col("_gone") - F.col("n_near"),
        "emptied": (F.col("_gone") > 0) & ~_has_words(F.coalesce("_text", F.lit("")), 1)})
    out = untouched.unionByName(joined.select("row", "_text", *ADDED))
    kept = [(F.col("_text") if c == text_col else F.col("row").getField(c)).alias(c) for c in others]
    return out.select(*kept, *ADDED)
