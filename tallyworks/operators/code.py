"""Index of source files by line patterns: declarations, imports and folders.

``lines``: path, line_no, line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as p

LONGEST_SIGNATURE = 160


def declarations(lines: DataFrame) -> DataFrame:
    """(path, nth, name, signature): exported declarations of each file in order, and plain ones at the line's begin."""
    exported, plain = F.regexp_extract("line", p.DECLARATION, 2), F.regexp_extract("line", p.PLAIN_DECLARATION, 2)
    name = F.when(exported != "", exported).otherwise(plain)
    found = lines.select("path", "line_no", name.alias("name"), F.trim("line").alias("signature"))
    found = found.where((F.col("name") != "") & (F.length("signature") < LONGEST_SIGNATURE))
    nth = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    return found.select("path", nth.alias("nth"), "name", "signature")


def interfaces(lines: DataFrame, most: int = 4) -> DataFrame:
    """The first declarations of each file."""
    return declarations(lines).where(F.col("nth") <= most)


CLOSERS = r"^[})\]]"


def extents(lines: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line) of every declaration: up to the line before the next one indented as little, or up to that line if it closes it.

    Methods have extents of their own inside a class's. Blank lines count
    nowhere; the last declaration ends with the file's last line of text. Only
    lines as little indented as some declaration of their file are put in order,
    once per such depth. The lines are read once: all windows are of one shuffle by path.
    """
    bare, line = F.trim(F.col("line"), F.lit(" \t")), F.col("line")
    text = lines.where(F.col("path").isNotNull() & (bare != ""))
    exported, plain = F.nullif(F.regexp_extract(line, p.DECLARATION, 2), F.lit("")), F.nullif(F.regexp_extract(bare, p.PLAIN_DECLARATION, 2), F.lit(""))
    depth = F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))
    text = text.select("path", "line_no", depth.alias("depth"), F.coalesce(exported, plain).alias("name"), F.when(bare.rlike(CLOSERS), depth).alias("closes"))
    file = Window.partitionBy("path")
    levels = F.collect_set(F.when(F.col("name").isNotNull(), F.col("depth"))).over(file)
    marks = text.select("*", F.max("line_no").over(file).alias("last"), levels.alias("levels"))
    marks = marks.select("path", "line_no", "depth", "name", "closes", "last", F.explode("levels").alias("level")).where("depth <= level")
    order = Window.partitionBy("path", "level").orderBy("line_no")
    marks = marks.withColumns({"next": F.lead("line_no").over(order), "closed": F.lead("closes").over(order) == F.col("depth")})
    marks = marks.where("name IS NOT NULL AND depth = level")
    end = F.when(F.col("next").isNull(), F.col("last")).when(F.col("closed"), F.col("next")).otherwise(F.col("next") - 1)
    return marks.select("path", "name", F.col("line_no").alias("start_line"), end.cast("int").alias("end_line"))


def symbol_table(lines: DataFrame) -> DataFrame:
    """(doc_id, symbol, start_line, end_line) as ``retrieval.zoom_ladder`` takes it, of documents that are source files (doc_id, line_no, line)."""
    found = extents(lines.withColumnRenamed("doc_id", "path"))
    return found.select(F.col("path").alias("doc_id"), F.col("name").alias("symbol"), "start_line", "end_line")


def relative_imports(lines: DataFrame) -> DataFrame:
    """(path, line_no, target) of every import of a relative module."""
    first, second = F.regexp_extract("line", p.RELATIVE_IMPORT, 1), F.regexp_extract("line", p.RELATIVE_FROM, 1)
    return lines.select("path", "line_no", F.when(first != "", first).otherwise(second).alias("target")).where("target <> ''")


def folder_role(folder):
    """Role of a folder by its last name."""
    name = F.substring_index(folder, "/", -1)
    role = F.when(name.rlike(p.FOLDER_ROLES[0][0]), p.FOLDER_ROLES[0][1])
    for pattern, said in p.FOLDER_ROLES[1:]:
        role = role.when(name.rlike(pattern), said)
    return role.otherwise("unclassified")


def folder_map(files: DataFrame, lines: DataFrame, each: int = 3, most: int = 8) -> DataFrame:
    """Every folder of ``files`` (path) with its role and its first distinct symbols: three of a file, eight in all."""
    folder = lambda path: F.regexp_replace(path, "/?[^/]*$", "")
    folders = files.select(F.coalesce(F.nullif(folder(F.col("path")), F.lit("")), F.lit(".")).alias("folder")).distinct()
    named = declarations(lines).where(F.col("nth") <= each)
    named = named.select(F.coalesce(F.nullif(folder(F.col("path")), F.lit("")), F.lit(".")).alias("folder"), "name", F.struct("path", "nth").alias("at"))
    once = named.groupBy("folder", "name").agg(F.min("at").alias("at"))
    once = once.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy("at"))).where(F.col("r") <= most)
    listed = once.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ",").alias("symbols"))
    return folders.join(listed, "folder", "left").select("folder", folder_role(F.col("folder")).alias("role"), F.coalesce("symbols", F.lit("")).alias("symbols"))
