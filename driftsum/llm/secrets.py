"""Secret scans with DataFrame functions alone.

Three patterns find assigned values, access keys and long hexadecimal runs. Beyond them, runs of
key characters are judged by two character Markov models, one of random strings and one of
ordinary identifiers: runs of 20 characters or more, and, beside a span of the patterns, what is left of
a run from ``LEAST`` characters on. The log-likelihood ratio is summed along the run and starts anew where it falls to 0
or by ``DROP``, so names before or after a random value do not count against it. A stretch between two
such places is a secret if its sum is at least ``MARGIN`` plus the logarithm of the run's length (by
chance, a model's sum reaches that in a share exp(-MARGIN) of runs), and at most ``THRESHOLD``; the span begins after the last separator
at or before its start and goes on to the next one, or to the run's ends. A run whose whole sum reaches ``THRESHOLD`` without such a
stretch is a secret as a whole. Both models are trained from labelled samples by counting neighbouring characters; the counts are
at most 2 x 67 x 67 numbers, and their ratio becomes one constant array in the plan.

Positions come from splitting a text at the matches: the running sums of the lengths of gaps and matches are
starts and ends in code points. Arrays and texts are worked through in chunks of bounded size, each value read once, so
the work grows in proportion to the text, however long it, its runs and its lists of matches are.

Defined results: null and empty texts have no spans; very long texts and runs are scanned whole; repeated rows
are scanned alike; of matches that overlap (ties included) each kind keeps its own; an empty table
gives an empty one; other columns stay as they are, whatever their names (result columns whose names
are taken get an underscore). Spans of the models overlap neither spans of the patterns nor each other. A
noncharacter U+FFFF in a text counts as the end of a span of a pattern beside which shorter pieces are judged.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsum.session import table

#: The patterns of the contract. Where a run shorter than the limit could never have
#: been part of a longer match, the limit is in the pattern; otherwise it is tested afterwards.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A character that no interchanged text has stands for those covered by spans of the patterns.
COVERED = "\uffff"
RUN = r"(?<=\uffff)[A-Za-z0-9+/_=-]{12,}|[A-Za-z0-9+/_=-]{12,}+(?=\uffff)|[A-Za-z0-9+/_=-]{20,}"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SAMPLES, THRESHOLD, PRIOR = 3000, 18.0, 0.5
#: LEAST: the fewest characters of a piece of a run, and of a stretch in it, that is judged (as in RUN).
MARGIN, DROP, LEAST, SEPARATORS = 8.0, 12.0, 12, "=/_-"
#: CHUNK: elements of an array, TEXT_CHUNK: characters of a text, that are worked through at once.
CHUNK, TEXT_CHUNK = 256, 4096

#: Words from which ordinary identifiers are made.
ORDINARY = """account action address after amount answer application array balance before between binary
bottom bridge browser buffer button cache center change channel character check children client
color column command common component config connection container content context control counter country
create current customer database default delete description detail device different direction directory
document double during element employee enable engine entry environment error event example exception
execute export factory feature field file filter first format forward frame function general global
group handler header height history image import index information initialize input instance integer
interface internal item journal kernel keyboard label language large layout length library limit
listener loader local location logger machine manager market master matrix memory message method
middle minute module monitor mouse movie music national network notification number object offset
operator option order other output package page parameter parent password path pattern person picture
pixel player pointer position previous process product profile project property provider public
quality query question random reader record reference register remote report request resource response
result return right river school screen search second section select server service session setting
should signal simple single socket source special standard start state station status storage stream
string student style summer support surface switch symbol system table target template terminal test
their there thing thought through ticket title together token toolbar total track transaction transfer
travel tree trigger under university update upload usage user utility validate value variable vector
version video view village virtual visible water weather website weight width window winter without
worker world wrapper writer yellow aujourd bonjour enfant maison monde nouveau pendant premier toujours
arbeit ausgabe eingabe fenster freund gesellschaft nachricht schule strasse verbindung zwischen
ciudad cuenta hermano mañana mensaje nombre pantalla siempre trabajo usuario""".replace("ñ", "n").split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES, seed: str = "train") -> DataFrame:
    """(text, random int): n random strings and n ordinary identifiers, made from hashes."""
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(base64, "[+/=]", "")
    forms = [digest, F.substring(base64, 1, 40), plain, F.upper(plain), F.lower(plain), F.upper(digest)]
    strings = ids.select(F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int")).alias("text"), F.lit(1).alias("random"))
    words = F.array(*map(F.lit, ORDINARY))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(k)), F.lit(len(ORDINARY))) + 1).cast("int"))
    w = [pick(k) for k in range(4)]
    number = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2100)).cast("string")
    forms = [
        F.concat_ws("_", *w),
        F.concat(w[0], F.initcap(w[1]), F.initcap(w[2]), F.initcap(w[3])),
        F.concat_ws("-", w[0], w[1], w[2], number),
        F.concat_ws("/", *w),
        F.upper(F.concat_ws("_", *w)),
        F.concat(*w),
        F.concat(F.initcap(w[0]), F.initcap(w[1]), F.initcap(w[2]), number),
        F.concat(w[0], F.lit("="), w[1], F.lit("+"), w[2]),
        F.concat(w[0], w[1], F.lit("-----=====_____")),
    ]
    names = ids.select(F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int")).alias("text"), F.lit(0).alias("random"))
    return strings.unionAll(names)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of neighbouring characters, row by row in the order of ALPHABET; characters outside it are skipped."""
    pairs = samples.where(F.length("text") > 1).select("random", F.explode(F.expr("transform(sequence(1, length(text) - 1), i -> substring(text, i, 2))")).alias("pair"))
    pairs = pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$"))  # so that at most 2 * 67**2 counts reach the driver
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}
    out = []
    for a in ALPHABET:
        totals = [sum(counts.get((y, a + b), 0) for b in ALPHABET) + PRIOR * len(ALPHABET) for y in (0, 1)]
        for b in ALPHABET:
            ordinary, random = (log((counts.get((y, a + b), 0) + PRIOR) / totals[y]) for y in (0, 1))
            out.append(round(random - ordinary, 4))
    return out


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _chunks(text: Column) -> Column:
    """The text as an array of strings of TEXT_CHUNK characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_CHUNK}}}"), F.lit(0))


def _constant(ratios: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:g}" for x in ratios)), ",").cast("array<double>")  # folded into a constant


def _places(chars: Column) -> Column:
    return F.transform(F.split(chars, ""), lambda c: F.position(c, F.lit(ALPHABET)))


def likelihood_ratio(run: Column, ratios: list[float]) -> Column:
    """The sum over the neighbouring characters of a string of ALPHABET characters."""
    values = _constant(ratios)

    def step(s: Column, place: Column) -> Column:
        ratio = F.when(s["before"] > 0, F.get(values, (s["before"] - 1) * len(ALPHABET) + place - 1)).otherwise(0.0)
        return F.struct(place.alias("before"), (s["sum"] + ratio).alias("sum"))

    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(_chunks(run), start, lambda s, chunk: F.aggregate(_places(chunk), s, step), lambda s: s["sum"])


_SPAN = "struct<start:int,rank:int,end:int>"
_SPANS = f"array<{_SPAN}>"


def _span(start: Column, rank: Column | int, end: Column) -> Column:
    return F.array(F.struct(start, F.lit(rank) if isinstance(rank, int) else rank, end)).cast(_SPANS)


def _no_spans() -> Column:
    return F.array().cast(_SPANS)


def _running(lengths: Column) -> Column:
    """Running sums of an array of whole numbers: sums inside chunks, and offsets over the chunks."""
    inside = lambda c: F.aggregate(c, F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)) + x)))

    def offset(s: Column, c: Column) -> Column:
        moved = F.transform(c, lambda x: x + s["at"])
        return F.struct((s["at"] + F.get(c, F.size(c) - 1)).alias("at"), F.concat(s["out"], F.array(moved)).alias("out"))

    def whole(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / CHUNK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: inside(F.slice(xs, i * CHUNK + 1, F.lit(CHUNK))))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.aggregate(cut, start, offset, lambda s: s["out"])))

    return _let(lengths, whole)


def _matches(t: Column, pattern: str, group: int = 0) -> Column:
    """(start, end, text, tested length) of the matches in ``t``, in order; ``text`` is the match, the length that of ``group``."""
    found, tested = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
    gaps = F.split(t, pattern, -1)  # one more than the matches

    def rows(texts: Column) -> Column:
        sizes = F.transform(texts, F.length)
        steps = F.zip_with(F.slice(F.transform(gaps, F.length), F.lit(1), F.size(texts)), sizes, lambda a, b: a + b)
        return F.arrays_zip(_running(steps).alias("end"), sizes.alias("size"), texts.alias("text"), F.transform(tested, F.length).alias("tested"))

    return _let(found, rows)


def _spans(t: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Sorted (start, rank, end) of the matches in ``t`` whose ``group`` has ``least`` characters."""
    kept = F.filter(_matches(t, pattern, group), lambda x: x["tested"] >= least)
    return F.when(t.rlike(pattern), F.transform(kept, lambda x: F.struct(x["end"] - x["size"], F.lit(rank), x["end"])).cast(_SPANS)).otherwise(_no_spans())


def _merged(spans: Column) -> Column:
    """The sorted spans without overlaps: spans that share characters become one."""

    def step(s: Column, x: Column) -> Column:
        joined = F.struct(s["out"], F.struct(s["last"]["start"], s["last"]["rank"], F.greatest(s["last"]["end"], x["end"])).cast(_SPAN))
        apart = F.struct(F.concat(s["out"], F.array(s["last"])), x)
        return F.when(s["last"].isNull(), F.struct(s["out"], x).cast(state)).when(x["start"] < s["last"]["end"], joined.cast(state)).otherwise(apart.cast(state))

    state = f"struct<out:{_SPANS},last:{_SPAN}>"
    outer = f"struct<done:array<{_SPANS}>,last:{_SPAN}>"

    def chunk(s: Column, xs: Column) -> Column:
        return _let(F.aggregate(xs, F.struct(_no_spans(), s["last"]).cast(state), step), lambda r: F.struct(F.concat(s["done"], F.array(r["out"])), r["last"]).cast(outer))

    def whole(xs: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda i: F.slice(xs, i * CHUNK + 1, F.lit(CHUNK)))
        start = F.struct(F.array().cast(f"array<{_SPANS}>"), F.lit(None).cast(_SPAN)).cast(outer)
        return F.when(F.size(xs) < 2, xs).otherwise(F.aggregate(cut, start, chunk, lambda s: F.concat(F.flatten(s["done"]), F.array(s["last"]))))

    return _let(spans, whole)


def _replaced(t: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """``t`` with each of the disjoint, sorted ``spans`` replaced, chunk by chunk, by ``fill(characters in the chunk, whether it starts there)``.

    ``at`` spans end before the chunk; those that touch it are among the next TEXT_CHUNK + 1.
    """
    state = "struct<i:int,at:int,out:array<string>>"

    def one(s: Column, chunk: Column, near: Column) -> Column:
        low = s["i"] * TEXT_CHUNK

        def step(r: Column, x: Column) -> Column:
            start, end = F.greatest(x["start"] - low, F.lit(0)), F.least(x["end"] - low, F.lit(TEXT_CHUNK))
            text = F.concat(r["out"], F.substring(chunk, r["at"] + 1, start - r["at"]), fill(end - start, x["start"] >= low))
            return F.struct(end.alias("at"), text.alias("out"))

        rest = lambda r: F.concat(r["out"], F.substring(chunk, r["at"] + 1, F.lit(TEXT_CHUNK)))
        inside = F.filter(near, lambda x: x["start"] < low + TEXT_CHUNK)
        text = F.when(F.size(near) == 0, chunk).otherwise(F.aggregate(inside, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest))
        behind = F.size(F.filter(near, lambda x: x["end"] <= low + TEXT_CHUNK))
        return F.struct(s["i"] + 1, s["at"] + behind, F.concat(s["out"], F.array(text))).cast(state)

    def whole(spans: Column) -> Column:
        step = lambda s, chunk: _let(F.slice(spans, s["at"] + 1, F.lit(TEXT_CHUNK + 1)), lambda near: one(s, chunk, near))
        return F.aggregate(_chunks(t), F.struct(F.lit(0), F.lit(0), F.array().cast("array<string>")).cast(state), step, lambda s: F.array_join(s["out"], ""))

    return _let(spans, whole)


_STATE = f"struct<i:int,before:int,total:double,sum:double,start:int,best:double,end:int,part:int,last:int,begin:int,stop:int,open:int,some:boolean,out:{_SPANS}>"


def _stretches(run: Column, n: Column, ratios: list[float]) -> Column:
    """Sorted, disjoint (start, rank, end) of the secrets in a string of ``n`` ALPHABET characters, counted from its start.

    One pass: i characters are behind; a stretch from ``start`` has its largest sum ``best`` at ``end``. ``part`` is where the
    part between separators begins that holds the last character, ``last`` the same one character before, ``begin`` that of ``start``;
    ``stop`` is the first separator after ``end``, and ``open`` the beginning of a span that ends at the next one (-1: none).
    """
    values, separators = _constant(ratios), F.array(*[F.lit(ALPHABET.index(c) + 1) for c in SEPARATORS])
    enough = F.least(F.lit(THRESHOLD), F.lit(MARGIN) + F.log(n))
    pack = lambda *x: F.struct(*x).cast(_STATE)
    none = F.lit(-1)
    secret = lambda s: (s["best"] >= enough) & (s["end"] - s["start"] >= LEAST)

    def closed(s: Column) -> tuple[Column, Column, Column]:
        """open, some and out after the stretch of ``s`` has ended."""
        waits = secret(s) & (s["stop"] < 0)
        return (
            F.when(waits & (s["open"] < 0), s["begin"]).otherwise(s["open"]), s["some"] | secret(s),
            F.when(secret(s) & (s["stop"] >= 0), F.concat(s["out"], _span(s["begin"], 4, s["stop"]))).otherwise(s["out"]),
        )

    def separated(s: Column, place: Column) -> Column:
        """``s`` after a look at whether the next character is a separator."""
        out = F.when(s["open"] >= 0, F.concat(s["out"], _span(s["open"], 4, s["i"]))).otherwise(s["out"])
        stop = F.when(s["stop"] < 0, s["i"]).otherwise(s["stop"])
        found = pack(s["i"], s["before"], s["total"], s["sum"], s["start"], s["best"], s["end"], s["i"] + 1, s["part"], s["begin"], stop, none, s["some"], out)
        other = pack(s["i"], s["before"], s["total"], s["sum"], s["start"], s["best"], s["end"], s["part"], s["part"], s["begin"], s["stop"], s["open"], s["some"], s["out"])
        return F.when(F.array_contains(separators, place), found).otherwise(other)

    def step(s: Column, place: Column) -> Column:
        """``last`` is, here, the part of the character before this one."""
        i = s["i"] + 1
        ratio = F.when(s["before"] > 0, F.get(values, (s["before"] - 1) * len(ALPHABET) + place - 1)).otherwise(0.0)
        first = s["sum"] == 0
        start, begin = F.when(first, F.greatest(s["i"] - 1, F.lit(0))).otherwise(s["start"]), F.when(first, s["last"]).otherwise(s["begin"])

        def moved(r: Column) -> Column:
            up, total = s["sum"] + r, s["total"] + r
            open_, some, out = closed(s)
            anew = pack(i, place, total, F.lit(0.0), s["i"], F.lit(0.0), s["i"], s["part"], s["last"], s["last"], none, open_, some, out)
            higher = pack(i, place, total, up, start, up, i, s["part"], s["last"], begin, none, s["open"], s["some"], s["out"])
            same = pack(i, place, total, up, start, s["best"], s["end"], s["part"], s["last"], begin, s["stop"], s["open"], s["some"], s["out"])
            return F.when((up <= 0) | (up < s["best"] - DROP), anew).when(up > s["best"], higher).otherwise(same)

        return _let(ratio, moved)

    zero = F.lit(0)
    begin = pack(zero, zero, F.lit(0.0), F.lit(0.0), zero, F.lit(0.0), zero, zero, zero, zero, none, none, F.lit(False), _no_spans())

    def end(s: Column) -> Column:
        open_, some, out = closed(s)
        return F.when(some, F.when(open_ >= 0, F.concat(out, _span(open_, 4, n))).otherwise(out)).when(s["total"] >= THRESHOLD, _span(zero, 4, n)).otherwise(_no_spans())

    walk = lambda s, chunk: F.aggregate(_places(chunk), s, lambda s, place: _let(separated(s, place), lambda s: step(s, place)))
    found = F.aggregate(_chunks(run), begin, walk, lambda s: _let(s, end))
    return _merged(found)


def _free(names: list[str], name: str) -> str:
    """``name``, with underscores until no column has it."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def _scan(docs: DataFrame, ratios: list[float], text: str) -> DataFrame:
    """row (all columns of ``docs``), t (the text, never null), base and secrets."""
    t = F.col("t")
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    out = out.select("*", F.array_sort(F.concat(_spans(t, ASSIGN, 1, group=2, least=6), _spans(t, ACCESS, 2), _spans(t, HEX, 3))).alias("base"))
    hidden = _replaced(t, _merged(F.col("base")), lambda n, _: F.repeat(F.lit(COVERED), n))
    out = out.withColumn("rest", F.when(F.size("base") > 0, hidden).otherwise(t))
    one = lambda x: _let(x["end"] - x["size"], lambda at: F.transform(_stretches(x["text"], x["size"], ratios), lambda p: F.struct(p["start"] + at, p["rank"], p["end"] + at).cast(_SPAN)))
    more = F.when(F.col("rest").rlike(RUN), F.flatten(F.transform(_matches(F.col("rest"), RUN), one))).otherwise(_no_spans())
    return out.select("row", "t", "base", F.array_sort(F.concat("base", more)).alias("secrets"))


def scan(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``secrets``: sorted arrays of (start, rank, end), of the patterns alone and with those of the models."""
    out = _scan(docs, ratios, text)
    return out.select("row.*", *[F.col(c).alias(_free(docs.columns, c)) for c in ("base", "secrets")])


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ratios: list[float], mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans in ``text`` replaced by ``mark``; n_chars, where there is one, counts anew in changed texts."""
    out, found = _scan(docs, ratios, "text"), F.size("secrets") > 0
    clean = _replaced(F.col("t"), _merged(F.col("secrets")), lambda _, here: F.when(here, F.lit(mark)).otherwise(""))
    out = out.select("row", "secrets", F.when(found, clean).alias("clean"))
    old = {c: F.col("row").getField(c) for c in docs.columns}
    new = {"text": F.when(found, F.col("clean")).otherwise(old["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(found, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(old["n_chars"])
    return out.select(*[new.get(c, old[c]).alias(c) for c in docs.columns])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs, train(labelled_samples(spark)))
    count = lambda rank: F.size(F.filter("base", lambda b: b["rank"] == rank)).cast("long")
    return out.select(
        "doc_id", count(1).alias("n_assign"), count(2).alias("n_access"), count(3).alias("n_hex"),
        F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("secrets")).alias("spans"),
    )


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets taken out of the text."""
    return redact(docs, train(labelled_samples(spark)))
