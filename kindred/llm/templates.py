"""Line dedup by a tree of line templates, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep

#: The tree's depth: below the number of tokens come so many leading tokens, and in a second tree so many trailing ones.
LEADING = 3
#: What a line is worth: its tokens, or its characters over this if that is more, as in writing without spaces.
CHARS = 6
#: Documents in which a line, or a template, has to occur, by what the line is worth: below each bound, and from the last on.
DOCS = ((3, 10), (8, 5), (50, 3))
DOCS_LONGEST = 2
#: A template has to occur in so many documents at least, however long it is.
DOCS_TEMPLATE = 3
#: Constants are this share of a template's tokens behind the leading ones, and so many, at least.
ALIKE, LEAST_ALIKE = 0.6, 3
#: The filter of lines: so many bits in parts of 4 KB, one megabyte in all.
FILTER, PART = 1 << 23, 1 << 15

_IN, _OUT = "[^\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D0-9@]"
#: A token that holds a digit or an at sign, with what stands before it. No part of a token is tried twice.
FIELD = f"(^|[\\x20\\x09-\\x0D]){_OUT}*+[0-9@]{_IN}*+"
#: White space within a line that is not one space.
WIDE = "\\x20[\\x20\\x09\\x0B-\\x0D]+|[\\x09\\x0B-\\x0D][\\x20\\x09\\x0B-\\x0D]*"
#: What lines hold that either of them changes: most lines have nothing of it.
ODD = "[0-9@\\x09\\x0B-\\x0D]|\\x20\\x20"


def _masked(line: Column) -> Column:
    changed = F.regexp_replace(F.regexp_replace(line, FIELD, "$1<*>"), WIDE, " ")
    return F.trim(F.when(F.rlike(line, F.lit(ODD)), changed).otherwise(line))


def _lines(docs: DataFrame) -> DataFrame:
    """A row per line that is not empty: id, place, line with its fields as <*>, tokens, worth, its two leaves and hash.

    Lines are masked and counted within the array that is exploded: there, each is once.
    """
    n = F.octet_length  # of one-byte spaces
    counted = lambda x: F.struct(x.alias("line"), (n(x) - n(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))
    rows = docs.select("id", F.posexplode(F.transform(F.transform(F.split("text", "\n"), _masked), counted)).alias("place", "of"))
    return rows.select("id", "place", "of.*").where("line <> ''").withColumns({
        "worth": F.greatest("n", F.floor(F.length("line") / CHARS).cast("int")),
        "head": F.xxhash64(F.lit(0), "n", F.substring_index("line", " ", LEADING)),
        "tail": F.xxhash64(F.lit(1), "n", F.substring_index("line", " ", -LEADING)), "hash": F.xxhash64("line")})


def _needed(worth: str) -> Column:
    out = F.when(F.lit(False), 0)
    for below, docs in DOCS:
        out = out.when(F.col(worth) < below, docs)
    return out.otherwise(DOCS_LONGEST)


def _filtered(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows whose hash may be among the lines': by a bitmap of fixed size, so that most rows need no shuffle."""
    slot = F.pmod(F.col("hash"), F.lit(FILTER))
    parts = lines.select((slot / PART).cast("int").alias("part"), (slot % PART).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bitmap = parts.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("bitmap"))
    bits = F.coalesce(F.try_element_at("bitmap", (slot / PART).cast("int")), F.lit(b""))
    byte = F.conv(F.hex(F.substring(bits, (slot % PART / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.crossJoin(F.broadcast(bitmap)).where(F.coalesce(F.call_function("getbit", byte, (slot % 8).cast("int")), F.lit(0)) == 1).drop("bitmap")


def _varied(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines that belong to a recurring template: head, hash, and the first document of the template.

    Only leaves that occur often enough and in more than one spelling are looked at, and of these each spelling
    once, in the first document that has it. A token's support is the number of documents that have it at its place, in its leaf.
    The constants of a line are the tokens of at least half the support that ALIKE of its tokens reach, and of
    DOCS_TEMPLATE documents; the others are fields, and lines of a leaf with the same constants are one template. So a leaf may hold many, frequent and rare
    ones, each known by the support of its own constants. Hot leaves, tokens and templates are grouped by partial sums, and
    what is joined to them was cut before, so that the joins can be split.
    """
    least = F.greatest(_needed("n"), F.lit(DOCS_TEMPLATE))
    leaves = F.explode(F.array(F.struct(F.col("head").alias("leaf"), F.lit(True).alias("at_head")), F.struct(F.col("tail").alias("leaf"), F.lit(False).alias("at_head"))))
    each = lines.where(F.col("n") >= LEADING + LEAST_ALIKE).select("head", "hash", "n", "docs", "first", leaves.alias("l")).select("*", "l.*").drop("l")
    often = each.groupBy("leaf", "n").agg(F.sum("docs").alias("all"), F.count("*").alias("kinds"))
    often = cut(often.where((F.col("kinds") > 1) & (F.col("all") >= least)).select(F.col("leaf").alias("often")))
    wanted = cut(each.join(often, F.col("leaf") == F.col("often")).select("leaf", "at_head", "head", "hash", "n", "docs", F.col("first").alias("id")).where("id IS NOT NULL"))
    firsts = wanted.select("id", "head", "hash").distinct()
    spelled = _filtered(_lines(docs), wanted).join(firsts, ["id", "head", "hash"]).select("head", "hash", F.split("line", " ").alias("tokens")).dropDuplicates(["head", "hash"])
    spelled = cut(spelled)
    own = lambda n: F.when(F.col("at_head"), F.slice("tokens", LEADING + 1, n)).otherwise(F.slice("tokens", 1, n))
    told = cut(wanted.join(spelled, ["head", "hash"]).select("leaf", "head", "hash", "docs", F.transform(own(F.col("n") - LEADING), lambda x: F.xxhash64(x)).alias("own")))
    placed = told.select("leaf", "head", "hash", "docs", F.posexplode("own").alias("place", "token"))
    support = placed.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("support")).where(F.col("support") >= DOCS_TEMPLATE)
    support = cut(support)
    known = placed.drop("docs").join(support, ["leaf", "place", "token"]).groupBy("leaf", "head", "hash").agg(
        F.collect_list(F.struct("place", "token", "support")).alias("s"))
    most = F.greatest(F.ceil(ALIKE * 10 * (F.col("n") - LEADING) / 10), F.lit(LEAST_ALIKE)).cast("int")
    level = F.try_element_at(F.sort_array(F.transform("s", lambda x: x["support"]), asc=False), F.col("most"))
    # Within the lambda the level is a value: as a column it would be found again for each token.
    fixed = lambda v: F.transform(F.filter("s", lambda x: 2 * x["support"] >= v), lambda x: F.struct(x["place"], x["token"]))
    read = F.transform(F.array(level), lambda v: F.struct(v.alias("level"), F.xxhash64(F.sort_array(fixed(v))).alias("template")))
    alike = wanted.drop("at_head").join(known, ["leaf", "head", "hash"]).withColumn("most", most).select("leaf", "head", "hash", "n", "docs", "id", F.explode(read).alias("r"))
    alike = cut(alike.where(F.col("r.level") >= least).select("leaf", "head", "hash", "n", "docs", "id", "r.template"))
    # Of spellings that one document brings first, one counts: a list within a document is not many documents.
    found = alike.groupBy("leaf", "template", "n", "id").agg(F.max("docs").alias("docs")).groupBy("leaf", "template", "n").agg(F.sum("docs").alias("docs"), F.min("id").alias("first"))
    found = cut(found.where(F.col("docs") >= least).select("leaf", "template", "first"))
    return alike.select("leaf", "template", "head", "hash").join(found, ["leaf", "template"]).select("head", "hash", "first")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, less the lines of recurring templates: adds n_lines and n_dropped to the columns.

    The tree: a line goes by its number of tokens and its LEADING first tokens to a leaf; tokens with digits or
    at signs are fields from the start. A leaf holds as many templates as its lines' tokens tell (see _varied). A second tree goes by the
    trailing tokens, so that fields in leading places are found too. A template, or a line by itself, that occurs in as many documents
    as DOCS asks for, fewer for longer lines, recurs: its lines go from all documents but the first, the one of the
    smallest id, so that nothing is lost everywhere. Lines are cut at line ends; what stays is unchanged.

    Lines are shuffled as hashes, two leaves and the line's own. Texts move once, to lose lines; and of leaves with
    several spellings, the lines.

    Nulls: a null text has no lines (n_lines 0) and stays null; rows of null id count as one
    document and keep their lines. Repeated rows count once and lose the same lines; different texts of one id are one document to the
    counts, and each loses its own lines. Lines of equal count or support need no order: nothing is cut off. Documents that lose
    all lines stay, with an empty text. A very long line, or a text of very many, is one row, or one array of rows, in memory. An empty table
    gives no rows. Other columns are carried, whatever their names.
    """
    # Which text of an id a line is of: its place alone would not tell texts of one id apart.
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    index = keep(_lines(docs.withColumn("id", F.struct("id", F.xxhash64("text").alias("text_hash")))).select(
        "id.id", "id.text_hash", "place", "n", "worth", "head", "tail", "hash"))
    lines = index.select("head", "tail", "hash", "n", "worth", "id").distinct().groupBy("head", "tail", "hash", "n", "worth").agg(F.count("*").alias("docs"), F.min("id").alias("first"))
    lines = cut(lines)
    alone = lines.where(F.col("docs") >= _needed("worth")).select("head", "hash", "first")
    recurring = alone.unionByName(_varied(docs, lines)).groupBy("head", "hash").agg(F.min("first").alias("first")).where("first IS NOT NULL")
    recurring = cut(recurring)  # so that the join with lines of very many documents can be split
    gone = index.select("id", "text_hash", "place", "head", "hash").join(recurring, ["head", "hash"]).where("id <> first").select("id", "text_hash", "place")
    held = gone.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__text")).agg(F.collect_set("place").alias("__places"))
    out = df.join(held, (F.col(id_col) == F.col("__id")) & (F.xxhash64(df[text_col]) == F.col("__text")), "left")
    split = F.split(df[text_col], "\n")
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("__places", i)), "\n")
    n = F.coalesce(F.size("__places"), F.lit(0))
    return out.select(
        *(F.when(F.col("__places").isNull(), df[c]).otherwise(left).alias(c) if c == text_col else df[c] for c in df.columns),
        F.when(df[text_col].isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(F.col("__places").isNull(), 0).otherwise(n).cast("long").alias("n_dropped"))
