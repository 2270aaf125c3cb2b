"""Personal data: identifiers of known forms, and further ones found by the contexts that the known ones stand in.

DataFrame functions only; texts never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumifield.functions.storage import store

KINDS = ("email", "ip", "card", "phone")
# Each form finds the same leftmost non-overlapping matches as the plain expression it stands for, in time linear in the text: runs are taken
# whole, and looked at from their first character only (for an email also from the end of the match before, \G). Matches of card
# with a number of digits other than 14 to 19 are left out at once.
FORMS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# A word that may name someone: with an @ or a spelt-out one, or four digits or more.
WORD = r"(?<!\S)(?=[^\s@]*+@|\S*?[(\[]at[)\]]|(?:[^\s0-9]*+[0-9]){4})\S++"
MAY = (r"@", r"[0-9]\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){13}", r"\+[0-9]", r"[0-9@]|[(\[]at[)\]]")  # what a text with a match has
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
OTHER = len(KINDS)  # the kind of a word whose kind is not known
REACH = 100  # characters of a neighbouring word that are compared, from the side of the identifier
ROUNDS, SUPPORT, SURE, ACCEPT = 3, 5.0, 0.75, 0.85


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Is the sum of the digits, every second one from the right doubled and cast to one digit, divisible by ten?"""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = digits.substr(i, F.lit(1)).cast("int") * (1 + (n - i) % 2)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _sound(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    return (F.when(kind == 0, True).when(kind == 1, value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
            .when(kind == 2, luhn(_digits(value))).when(kind == 3, n.between(10, 15)).otherwise(True))


def _words(piece: Column) -> Column:
    return F.filter(F.split(F.lower(piece), r"\s+"), lambda w: w != "")


def hits(docs: DataFrame) -> DataFrame:
    """(row, doc_id, hits): row numbers the rows of ``docs``; hits are the matches of each form and the words that may name someone.

    A hit has kind, place (its number in the text), gap (characters since the hit before it of its kind), size, value, and the
    words around it: two to the left and one to the right.
    """
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = d.select("row", "doc_id", *[c for k, form in enumerate((*FORMS, WORD)) for c in (
        F.when(F.col("t").rlike(MAY[k]), F.split("t", form, -1)).alias(f"p{k}"),
        F.when(F.col("t").rlike(MAY[k]), F.regexp_extract_all("t", F.lit(form), F.lit(0))).alias(f"v{k}"))])

    def each(k: int) -> Column:
        pieces = F.col(f"p{k}")

        def hit(value: Column, i: Column) -> Column:
            before, after = F.get(pieces, i), F.get(pieces, i + 1)
            left = _words(F.right(before, F.lit(2 * REACH)))
            at = lambda n: F.right(F.coalesce(F.try_element_at(left, F.lit(n)), F.lit("")), F.lit(REACH))
            right = F.left(F.coalesce(F.get(_words(F.left(after, F.lit(2 * REACH))), F.lit(0)), F.lit("")), F.lit(REACH))
            return F.struct(F.lit(k).alias("kind"), i.alias("place"), F.length(before).cast("long").alias("gap"), F.length(value).cast("long").alias("size"),
                            value.alias("value"), at(-2).alias("left2"), at(-1).alias("left"), right.alias("right"))

        return F.when(pieces.isNull(), F.array().cast(
            "array<struct<kind:int,place:int,gap:bigint,size:bigint,value:string,left2:string,left:string,right:string>>")).otherwise(F.transform(f"v{k}", hit))

    return found.select("row", "doc_id", F.concat(*[each(k) for k in range(OTHER + 1)]).alias("hits"))


def mentions(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, left2, left, right): sound identifiers of each kind, and words of kind ``OTHER`` that overlap none of them."""
    hit = found.where(F.size("hits") > 0).select("row", F.inline("hits")).repartition("row")
    by_kind = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(by_kind)
    placed = hit.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where(_sound(F.col("kind"), F.col("value")))
    # a word is taken without the quotes, brackets and points around it
    other, core = F.col("kind") == OTHER, F.regexp_replace("value", r"^[\"'(\[{<]++", "")
    bare = F.regexp_replace(core, r"[.,;:!?)\]}>\"']+$", "")
    start = F.when(other, F.col("start") + F.length("value") - F.length(core)).otherwise(F.col("start"))
    placed = placed.select("row", "kind", start.alias("start"), "end", F.when(other, bare).otherwise(F.col("value")).alias("value"), "left2", "left", "right")
    placed = placed.withColumn("end", F.when(other, F.col("start") + F.length("value")).otherwise(F.col("end"))).where("end > start")
    line = Window.partitionBy("row").orderBy("start", "kind")
    known = F.col("kind") < OTHER
    reached = F.max(F.when(known, F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(known, F.col("start"))).over(line.rowsBetween(0, Window.unboundedFollowing))
    placed = placed.withColumn("reached", reached).withColumn("ahead", ahead)
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))
    return placed.where(known | free).drop("reached", "ahead")


def _patterns() -> Column:
    """The lexical patterns of a mention: the two words before it, and the words on either side."""
    two = F.when((F.col("left") != "") & (F.col("left2") != ""), F.concat_ws(" ", "left2", "left", F.lit("_")))
    both = F.when((F.col("left") != "") & (F.col("right") != ""), F.concat_ws(" ", "left", F.lit("_"), "right"))
    return F.filter(F.array(two, both), lambda p: p.isNotNull())


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, sure: float = SURE, accept: float = ACCEPT) -> DataFrame:
    """(row, start, end, kind) of the mentions of unknown kind that patterns show to be of a kind.

    A pattern and a value are linked where the value stands in the pattern; known identifiers are seeds. In each round a pattern's confidence for a
    kind is the sum of its values' scores, 1 for seeds, over the number of its different values and one more; it counts from ``sure`` on and
    with a sum of ``support``. An unknown value's score is the chance that one of its counting patterns is right. A mention is found
    if its value's score reaches ``accept`` and it stands in a counting pattern of that kind.
    """
    edges = found.select("row", "start", "end", "kind", F.lower("value").alias("value"), F.explode(_patterns()).alias("pattern"))
    graph = edges.groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    graph, _ = store(graph, "graph")
    wide, _ = store(graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.max("kind").alias("last")).where(
        (F.col("values") >= support) & (F.col("last") == OTHER)).select("pattern", "values"), "patterns")
    graph, _ = store(graph.join(wide, "pattern"), "graph")
    ks = range(len(KINDS))
    scores, sound = None, None
    for _ in range(rounds):
        if scores is None:
            known = graph.select("*", *[F.lit(0.0).alias(f"s{k}") for k in ks])
        else:
            known = graph.join(scores, "value", "left").na.fill(0.0, [f"s{k}" for k in ks])
        mass = [F.round(F.sum(F.when(F.col("kind") == k, 1.0).when(F.col("kind") == OTHER, F.col(f"s{k}")).otherwise(0.0)), 6).alias(f"m{k}") for k in ks]
        conf = [F.when((F.col(f"m{k}") >= support) & (F.col(f"m{k}") >= sure * (F.col("values") + 1)), F.col(f"m{k}") / (F.col("values") + 1)).otherwise(0.0).alias(f"c{k}") for k in ks]
        sound, _ = store(known.groupBy("pattern", "values").agg(*mass).select("pattern", *conf).where(F.greatest(*[F.col(f"c{k}") for k in ks]) > 0), "sound")
        near = graph.where(F.col("kind") == OTHER).join(sound, "pattern").groupBy("value").agg(
            *[F.round(1 - F.exp(F.sum(F.log(1 - F.col(f"c{k}")))), 6).alias(f"s{k}") for k in ks])
        scores, _ = store(near, "scores")
    top = F.greatest(*[F.col(f"s{k}") for k in ks])
    which = F.coalesce(*[F.when(F.col(f"s{k}") == top, k) for k in ks])
    sure_of = scores.where(top >= accept).select("value", which.alias("as"))
    chosen = edges.where(F.col("kind") == OTHER).join(sound, "pattern").join(sure_of, "value")
    fits = F.greatest(*[F.when(F.col("as") == k, F.col(f"c{k}")) for k in ks]) > 0
    return chosen.where(fits).select("row", "start", "end", F.col("as").alias("kind")).distinct()


def find(docs: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, sure: float = SURE, accept: float = ACCEPT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, spans (kind, start, end, known), ordered by start and kind.

    Places count in characters, the end is exclusive. ``known`` spans match a form (see ``FORMS``): emails; addresses of four parts up to 255; card numbers
    of 14 to 19 digits whose checksum is right; phone numbers of 10 to 15 digits after a plus. The others are found by
    :func:`bootstrap` in words with an @, a spelt-out one or four digits, in the contexts of known ones; they overlap no known span.

    Spans of different kinds may overlap. Null and empty texts have none. Texts of any length are read whole; repeated rows have their
    spans each (a value counts once in a pattern however often it stands there). No rows give no rows; other columns are ignored.
    A document's spans are put in order in one task, a pattern's and a value's are only ever summed.
    """
    table, _ = store(hits(docs), "hits")
    known, _ = store(mentions(table), "mentions")
    more = bootstrap(known, rounds, support, sure, accept)
    spans = known.where(F.col("kind") < OTHER).select("row", "start", "end", "kind", F.lit(True).alias("known")).unionByName(more.withColumn("known", F.lit(False)))
    spans, _ = store(spans, "spans")
    lists = spans.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "known"))).alias("spans"))
    out = table.select("row", "doc_id").join(lists, F.col("row") == F.col("of"), "left")
    empty = F.array().cast("array<struct<start: bigint, kind: int, end: bigint, known: boolean>>")
    return out.select("doc_id", F.coalesce("spans", empty).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kind = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
