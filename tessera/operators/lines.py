"""Line-oriented text analysis as relations: (key, line_no, line) instead of shell pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_table(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return files.select(key, F.posexplode(F.split(text, "\n", -1)).alias("__i", "line")).select(key, (F.col("__i") + 1).alias("line_no"), "line")


def grep(lines: DataFrame, pattern: str, ignore_case: bool = False, invert: bool = False) -> DataFrame:
    hit = F.col("line").rlike(("(?i)" if ignore_case else "") + pattern)
    return lines.where(~hit if invert else hit)


def grep_only(lines: DataFrame, pattern: str, key: str = "path") -> DataFrame:
    """(key, line_no, match): every match by itself."""
    return lines.select(key, "line_no", F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("match"))


def grep_context(lines: DataFrame, pattern: str, before: int = 0, after: int = 0, key: str = "path") -> DataFrame:
    """Matching lines with their neighbours; matched tells them apart."""
    order = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("matched", F.col("line").rlike(pattern))
    near = F.max("matched").over(order.rowsBetween(-after, before))
    return marked.withColumn("__near", near).where("__near").drop("__near")


def grep_count(lines: DataFrame, pattern: str, key: str = "path") -> DataFrame:
    return lines.groupBy(key).agg(F.count_if(F.col("line").rlike(pattern)).alias("hits"))


def word_count(files: DataFrame, by: Column | str, text: str = "text") -> DataFrame:
    """wc: newlines, words and bytes of the files of each group."""
    t = F.col(text)
    return files.groupBy((F.col(by) if isinstance(by, str) else by).alias("grp")).agg(
        F.count("*").alias("files"), F.sum(F.length(t) - F.length(F.replace(t, F.lit("\n")))).cast("long").alias("newlines"),
        F.sum(F.size(F.filter(F.split(t, r"[ \t\n\r\f\x0b]+"), lambda w: w != ""))).cast("long").alias("words"), F.sum(F.octet_length(t)).cast("long").alias("bytes"),
    )


def sort_uniq_count(lines: DataFrame) -> DataFrame:
    """sort | uniq -c."""
    return lines.groupBy("line").agg(F.count("*").alias("n"))


def head(lines: DataFrame, n: int) -> DataFrame:
    """First n lines of each file: no sort, the number is known."""
    return lines.where(F.col("line_no") <= n)


def tail(files: DataFrame, n: int, key: str = "path", text: str = "text") -> DataFrame:
    """Last n lines of each file, from its own array of lines."""
    every = F.split(text, "\n", -1)
    counted = files.select(key, every.alias("__l"), F.size(every).alias("__n"))
    first = F.greatest(F.col("__n") - n, F.lit(0))
    return counted.select(key, first.alias("__f"), F.posexplode(F.slice("__l", first + 1, F.lit(n))).alias("__i", "line")).select(key, (F.col("__f") + F.col("__i") + 1).alias("line_no"), "line")


def cut_field(lines: DataFrame, separator: str, n: int, key: str = "path") -> DataFrame:
    """cut -d -f: lines without the separator stay whole."""
    parts = F.split_part("line", F.lit(separator), F.lit(n))
    return lines.select(key, "line_no", F.when(F.col("line").contains(separator), parts).otherwise(F.col("line")).alias("field"))


def substitute(lines: DataFrame, pattern: str, new: str) -> DataFrame:
    """sed s///g."""
    return lines.withColumn("line", F.regexp_replace("line", pattern, new))


def translate(lines: DataFrame, old: str, new: str) -> DataFrame:
    """tr."""
    return lines.withColumn("line", F.translate("line", old, new))


def diff_lines(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """(key, line_no, old, new) of the lines that differ by number."""
    joined = left.withColumnRenamed("line", "old").join(right.withColumnRenamed("line", "new"), [key, "line_no"], "full_outer")
    return joined.where(~F.col("old").eqNullSafe(F.col("new"))).select(key, "line_no", "old", "new")


def json_value(column: Column | str, path: str) -> Column:
    """jq for one value."""
    return F.get_json_object(column, path)


def digests(text: str = "text") -> dict[str, Column]:
    return {"md5": F.md5(F.col(text)), "sha256": F.sha2(F.col(text), 256)}


def strings(content: Column | str, least: int = 4) -> Column:
    """Runs of printable ASCII in bytes."""
    readable = F.decode(F.col(content) if isinstance(content, str) else content, "ISO-8859-1")
    return F.regexp_extract_all(readable, F.lit(f"[\\x20-\\x7e]{{{least},}}"), F.lit(0))


def octal_dump(content: Column | str) -> Column:
    return F.lower(F.hex(F.col(content) if isinstance(content, str) else content))


def tree(files: DataFrame, key: str = "path") -> DataFrame:
    """(directory, depth, files, bytes) of every directory, the files below it counted; needs length."""
    parts = F.split(key, "/")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = files.select(F.explode(levels).alias("directory"), "length")
    depth = F.when(F.col("directory") == "", F.lit(0)).otherwise(F.size(F.split("directory", "/")))
    return each.groupBy("directory").agg(F.count("*").alias("files"), F.sum("length").cast("long").alias("bytes")).withColumn("depth", depth)


def split_parts(lines: DataFrame, n: int) -> DataFrame:
    """split -l: the number of the part of n lines that a line is in."""
    return lines.withColumn("part", F.floor((F.col("line_no") - 1) / n).cast("int"))


def dirname(path: Column | str) -> Column:
    return F.regexp_replace(F.when((F.col(path) if isinstance(path, str) else path).contains("/"), path).otherwise(F.lit("./")), "/[^/]*$", "")


def migrations(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, version, name) of migration files V<version>__<name>.sql, for the history of a schema."""
    name = F.element_at(F.split(key, "/"), -1)
    pattern = r"^V([0-9][0-9._]*)__(.+)\.sql$"
    found = files.where(name.rlike(pattern))
    return found.select(key, F.regexp_extract(name, pattern, 1).alias("version"), F.replace(F.regexp_extract(name, pattern, 2), F.lit("_"), F.lit(" ")).alias("name"))
