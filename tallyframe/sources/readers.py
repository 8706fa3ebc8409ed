"""Files as tables: delimited text, JSON, XML, columnar formats and landed pages."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.cells import q
from tallyframe.operators.schemas import expected_schema_diff
from tallyframe.session import few_listing_tasks, materialise
from tallyframe.sources.documents import (
    FILE, as_element, json_records, scan_json, scan_xml, whole_xml, xml_records, xml_shapes,
)
from tallyframe.sources.quoted import field_count, joined_lines, opens

# Delimiters tried in order, the words read as missing.
DELIMITERS = (",", "\t", ";", "|")
MISSING_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
FEW_FILES = 100_000  # up to so many rows of one per file are broadcast


def _fields(line: str, delimiter: str) -> int:
    return len(next(csv.reader([line], delimiter=delimiter)))


def _filled(line: str) -> bool:
    stripped = line.strip()
    return bool(stripped) and set(stripped) != {"-"}


def sniff_header(lines: Sequence[str]) -> tuple[int, str] | None:
    """The first line that has as many fields, at least two, as the next filled line; for lines at hand."""
    for delimiter in DELIMITERS:
        filled = [(i, line) for i, line in enumerate(lines) if _filled(line)]
        for (i, line), (_, below) in zip(filled, filled[1:]):
            n = _fields(line, delimiter)
            if n >= 2 and n == _fields(below, delimiter):
                return i, delimiter
    return None


def is_ragged(lines: Sequence[str]) -> bool:
    """Whether some line has more comma fields than the first one; for lines at hand."""
    filled = [line for line in lines if line.strip()]
    return bool(filled) and any(_fields(line, ",") > _fields(filled[0], ",") for line in filled)


def typed(df: DataFrame, keep: Sequence[str | None] = ()) -> DataFrame:
    """Fold the words for missing and give each text column the narrowest fitting type."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in keep]
    if not names:
        return df
    folded = df.select(*[
        F.when(~q(c).isin(*MISSING_WORDS), q(c)).alias(c) if c in names else q(c).alias(c) for c in df.columns
    ])
    whole, real, flag = r"^\s*[+-]?\d{1,18}\s*$", r"(?i)^\s*[+-]?(inf|infinity|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)\s*$", "^(True|False|TRUE|FALSE|true|false)$"
    row = folded.agg(*[
        F.count_if(q(c).isNotNull() & ~q(c).rlike(p)).alias(f"{k}{i}")
        for i, c in enumerate(names) for k, p in (("w", whole), ("r", real), ("f", flag))
    ], *[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    kinds = {}
    for i, c in enumerate(names):
        if not row[f"n{i}"]:
            continue
        if not row[f"w{i}"]:
            kinds[c] = "bigint"
        elif not row[f"r{i}"]:
            kinds[c] = "double"
        elif not row[f"f{i}"]:
            kinds[c] = "boolean"
    # All values fit; a plan may still ask for header lines before they are cut, so the cast must not fail.
    return folded.select(*[
        F.trim(q(c)).try_cast(kinds[c]).alias(c) if c in kinds else q(c).alias(c) for c in folded.columns
    ])


def _numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The lines of all files: their file, the start of their block and their place behind it.

    The low bits of the generated number count the rows of a scan's partition, so
    they are the same wherever the scan stands in a plan.
    """
    with few_listing_tasks(spark):
        read = spark.read.text(path)
    return read.select(
        F.regexp_replace("value", "^\ufeff", "").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("line"),
    )


def _field_count(delimiter: str) -> Column:
    return field_count(F.col("value"), delimiter)


def _sniffed(ragged: DataFrame) -> DataFrame:
    """Header of each file: the first line with as many fields, at least two, as the next filled line.

    Delimiters are tried in order. Neighbours are looked up within a block, which
    the scan bounds, and across the ends of blocks by one row for each of them.
    """
    lines = ragged.where(~F.trim("value").rlike("^-*$")).withColumn(
        "n", F.array(*[_field_count(d) for d in DELIMITERS])
    )
    inside = Window.partitionBy("file", "start").orderBy("line")
    blocks = lines.groupBy("file", "start").agg(F.min_by("n", "line").alias("first_n"))
    following = blocks.select(
        "file", "start", F.lead("first_n").over(Window.partitionBy("file").orderBy("start")).alias("first_of_next")
    )
    near = lines.withColumn("next_n", F.lead("n").over(inside)).join(following, ["file", "start"])
    pairs = near.select(
        "file", "start", "line", "value", F.posexplode("n").alias("d", "fields"),
        F.coalesce("next_n", "first_of_next").alias("below"),
    ).where((F.col("fields") >= 2) & (F.get("below", F.col("d")) == F.col("fields")))
    return pairs.groupBy("file").agg(F.min(F.struct("d", "start", "line", "value")).alias("at")).select(
        "file", F.element_at(F.array(*[F.lit(d) for d in DELIMITERS]), F.col("at.d") + 1).alias("delimiter"),
        F.col("at.value").alias("header"), F.col("at.start").alias("from_start"), F.col("at.line").alias("from_line"),
        F.lit(True).alias("sniffed"),
    )


def _first_look(lines: DataFrame, sep: str | None, multi_line: bool = False) -> DataFrame:
    """Per file its first filled line, the most fields of any, and whether some line ends inside quotes."""
    open_end = opens(F.col("value"), sep or "".join(DELIMITERS)) if multi_line else F.lit(False)
    filled = lines.where(F.trim("value") != "").withColumn("n", _field_count(sep or ","))
    return filled.groupBy("file").agg(
        F.min(F.struct("start", "line", "value", "n")).alias("first"), F.max("n").alias("widest"),
        F.max(open_end).alias("broken"),
    )


def _records_and_layouts(spark: SparkSession, path: str | Sequence[str], sep: str | None,
                         multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """The records of all files, and delimiter and header record of every file, each from its own whole text.

    A file is comma text under its first record, unless some record has more
    fields than that; then delimiter and header are sniffed. Only files in which
    a line ends inside quotes have their lines joined.
    """
    lines = _numbered_lines(spark, path)
    files = materialise(_first_look(lines, sep, multi_line), "csv-files")
    broken = files.where("broken").select("file")
    if multi_line and not broken.isEmpty():
        whole = materialise(
            joined_lines(lines.join(broken, "file", "left_semi"), sep or "".join(DELIMITERS)), "csv-joined"
        )
        files = files.join(broken, "file", "left_anti").unionByName(_first_look(whole, sep))
        lines = lines.join(broken, "file", "left_anti").unionByName(whole)
    plain = files if sep else files.where(F.col("widest") <= F.col("first.n"))
    found = plain.select(
        "file", F.lit(sep or ",").alias("delimiter"), F.col("first.value").alias("header"),
        F.col("first.start").alias("from_start"), F.col("first.line").alias("from_line"), F.lit(False).alias("sniffed"),
    )
    if not sep:
        ragged = files.where(F.col("widest") > F.col("first.n")).select("file")
        filled = lines.where(F.trim("value") != "")
        sniffed = ragged.join(_sniffed(filled.join(ragged, "file", "left_semi")), "file", "left")
        found = found.unionByName(sniffed)
    return lines, materialise(found, "csv-layouts")


def unreadable_files(spark: SparkSession, path: str | Sequence[str], fmt: str) -> DataFrame:
    """``file, problem`` for the text files that :func:`read_files` could not read to the end.

    Delimited files need a header line and no line with more fields than that;
    JSON lines need to be objects, JSON and XML documents to be whole. Each is a scan and a grouped aggregate.
    Columnar files are not looked into.
    """
    if fmt == "jsonl":
        bad = F.get_json_object("value", "$").isNull() | ~F.ltrim("value").startswith("{")
        return _numbered_lines(spark, path).where((F.trim("value") != "") & bad).select(
            "file", F.lit("line is no JSON object").alias("problem")
        ).distinct()
    if fmt == "json":
        return scan_json(spark, path).where("kind = 'bad'").select("file", F.lit("not JSON").alias("problem"))
    if fmt == "xml":
        return whole_xml(spark, path, problems_only=True).select("file", "problem").unionByName(
            scan_xml(spark, path).select("file", "problem")).where("problem is not null").distinct()
    if fmt not in ("csv", "tsv"):
        return spark.createDataFrame([], "file string, problem string")
    lines, layouts = _records_and_layouts(spark, path, "\t" if fmt == "tsv" else None)
    headless = layouts.where("header is null").select("file", F.lit("no header line").alias("problem"))
    plain = layouts.where("header is not null and not sniffed").withColumn("value", F.col("header")).select(
        "file", "delimiter", _field_count(",").alias("commas"), _field_count("\t").alias("tabs")
    )
    comma = F.col("delimiter") == ","
    wrong = F.when(comma, _field_count(",") != F.col("commas")).otherwise(_field_count("\t") != F.col("tabs"))
    cut_off = F.when(comma, opens(F.col("value"), ",")).otherwise(opens(F.col("value"), "\t"))
    malformed = lines.where(F.trim("value") != "").join(plain, "file").where(wrong | cut_off).select(
        "file", F.lit("malformed line").alias("problem")
    ).distinct()
    return headless.unionByName(malformed)


def _header_names(header: str, delimiter: str) -> list[str]:
    names: list[str] = []
    for k, name in enumerate(next(csv.reader([header], delimiter=delimiter))):
        name = unique = name.strip() or f"_c{k}"
        n = 1
        while unique in names:
            n += 1
            unique = f"{name}_{n}"
        names.append(unique)
    return names


def read_delimited(spark: SparkSession, path: str | Sequence[str], sep: str | None = None,
                   schema: str | T.StructType | None = None, path_column: str | None = None,
                   multi_line: bool = True) -> DataFrame:
    """Delimited text, each file under its own header; ``path_column`` keeps the file of each row.

    Without ``sep`` a file is comma text unless it is ragged: then its delimiter
    and header line are sniffed and the lines above are cut. All files are parsed
    in one scan, whatever the number of headers, and united by column name.
    Quoted fields may hold line breaks, which become line feeds; without
    ``multi_line`` each line is a record.
    """
    records, layouts = _records_and_layouts(spark, path, sep, multi_line)
    # One row for each different header.
    shapes = layouts.groupBy("delimiter", "header", "sniffed").agg(F.count(F.lit(1)).alias("files")).collect()
    if any(s["header"] is None for s in shapes):
        raise ValueError("no header line found")
    if not shapes:
        return spark.createDataFrame([], "value string").drop("value")
    few = sum(s["files"] for s in shapes) <= FEW_FILES
    shapes.sort(key=lambda s: (s["header"], s["delimiter"]))
    headers = [_header_names(s["header"], s["delimiter"]) for s in shapes]
    known = spark.createDataFrame(
        [(s["delimiter"], s["header"], s["sniffed"], len(names), {n: k for k, n in enumerate(names)})
         for s, names in zip(shapes, headers)],
        "delimiter string, header string, sniffed boolean, width int, places map<string,int>",
    )
    own = layouts.join(F.broadcast(known), ["delimiter", "header", "sniffed"]).drop("header")
    below = records.join(F.broadcast(own) if few else own, "file").where(
        (F.col("start") > F.col("from_start")) | ((F.col("start") == F.col("from_start")) & (F.col("line") > F.col("from_line")))
    ).where(F.when(F.col("sniffed"), ~F.trim("value").rlike("^-*$")).otherwise(F.trim("value") != ""))
    cells = F.lit(None)
    for d in sorted({s["delimiter"] for s in shapes}, reverse=True):
        widest = max(len(names) for s, names in zip(shapes, headers) if s["delimiter"] == d)
        wrong = ~F.col("sniffed") & (_field_count(d) != F.col("width"))
        line = F.when(wrong, F.raise_error(F.concat(F.lit("malformed line in "), "file"))).otherwise(F.col("value"))
        numbered = [f"c{k}" for k in range(widest)]
        parsed = F.from_csv(line, _ddl(numbered), {
            "sep": d, "mode": "PERMISSIVE", "escape": '"', "maxColumns": str(max(20480, widest + 1))})
        if len(shapes) > 1:
            parsed = F.transform(F.array(parsed), lambda r: F.array(*[r[c] for c in numbered]))[0]
        cells = parsed if len(shapes) == 1 else F.when(F.col("delimiter") == d, parsed).otherwise(cells)
    kept = [F.col("file").alias(path_column)] if path_column else []
    read = below.select(cells.alias("cells"), "file", "places")
    if len(shapes) == 1:
        table = read.select(*[F.col(f"cells.c{k}").alias(n) for k, n in enumerate(headers[0])], *kept)
    else:
        table = read.select(*[
            F.get("cells", F.element_at("places", F.lit(n))).alias(n) for n in dict.fromkeys(n for names in headers for n in names)
        ], *kept)
    if schema is None:
        return typed(table, (path_column,))
    target = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    kept = [q(path_column)] if path_column else []
    return table.select(*[
        (q(f.name).cast(f.dataType) if f.name in table.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in target
    ], *kept)


def _ddl(names: Sequence[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` STRING" for n in names)


def _with_path(df: DataFrame, path_column: str | None) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias(path_column)) if path_column else df


# -- Nested data -----------------------------------------------------------


def flattened(df: DataFrame, mark: str = "") -> DataFrame:
    """Struct fields as dotted columns; a leading ``mark`` on attribute names is dropped."""
    out: list[Column] = []
    used: set[str] = set()

    def walk(c: Column, t: T.DataType, name: str) -> None:
        if isinstance(t, T.StructType):
            for f in t:
                part = f.name[len(mark):] if mark and f.name.startswith(mark) else f.name
                inner = name if mark and part == "_VALUE" else f"{name}.{part}" if name else part
                walk(c.getField(f.name), f.dataType, inner)
            return
        unique, n = name, 1
        while unique in used:
            n += 1
            unique = f"{name}_{n}"
        used.add(unique)
        out.append(c.alias(unique))

    for f in df.schema:
        part = f.name[len(mark):] if mark and f.name.startswith(mark) else f.name
        walk(q(f.name), f.dataType, part)
    return df.select(*out)


def read_json_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return flattened(spark.read.json(path))


def read_json(spark: SparkSession, path: str | Sequence[str], path_column: str | None = None) -> DataFrame:
    """Documents as records, each file by its own structure, united by column name.

    A list gives a row for each element, an object its first list of records or
    itself. ``path_column`` keeps the file of each row.
    """
    documents = scan_json(spark, path)
    bad = documents.where("kind = 'bad'").select("file").first()
    if bad is not None:
        raise ValueError(f"not JSON: {bad['file']}")
    raw = spark.read.schema("f string").json(folder := json_records(spark, documents))
    if raw.isEmpty():
        return spark.createDataFrame([], f"{path_column} string" if path_column else "value string")
    raw = spark.read.json(folder)
    place = [F.col("f").alias(path_column)] if path_column else []
    if isinstance(raw.schema["r"].dataType, T.StructType):
        return flattened(raw.select("r.*", *place))
    return typed(raw.select(F.col("r").alias("value"), *place), (path_column,))


def _records_at(raw: DataFrame, place: Sequence[str]) -> DataFrame:
    found = reduce(lambda c, name: c.getField(name), place[1:], q(place[0]))
    return flattened(raw.select(F.explode(found).alias("r")).select("r.*"))


def read_pages(spark: SparkSession, path: str, root: str = "", fmt: str = "json") -> DataFrame:
    """Landed response pages as one table; ``root`` names the list inside each page."""
    if fmt == "csv":
        return read_delimited(spark, path)
    raw = spark.read.json(path, multiLine=True)
    if not root:
        return flattened(raw)
    t: T.DataType = raw.schema
    for part in root.split("."):
        if not isinstance(t, T.StructType) or part not in t.fieldNames():
            raise ValueError(f"'{root}' does not lead to a list of records")
        t = t[part].dataType
    if not isinstance(t, T.ArrayType):
        raise ValueError(f"'{root}' does not lead to a list of records")
    if not isinstance(t.elementType, T.StructType):
        found = reduce(lambda c, name: c.getField(name), root.split(".")[1:], q(root.split(".")[0]))
        return raw.select(F.explode(found).alias("value"))
    return _records_at(raw, root.split("."))


# -- XML -------------------------------------------------------------------


def read_xml(spark: SparkSession, path: str | Sequence[str], tag: str | None = None,
             path_column: str | None = None) -> DataFrame:
    """XML records as flat text columns; attributes and nested elements become dotted names.

    The records of each file are found by its own whole structure, or are all
    elements named ``tag``; ``path_column`` keeps the file of each row.
    """
    whole, places = whole_xml(spark, path, tag), scan_xml(spark, path, tag)
    bad = whole.select("file", "problem").unionByName(places.select("file", "problem")).where("problem is not null").first()
    if bad is not None:
        raise ValueError(f"{bad['problem']}: {bad['file']}")
    records = whole.select("file", "body", "new").unionByName(xml_records(spark, path, places))
    shapes = xml_shapes(spark, records)
    if shapes is None:  # no records at all
        return spark.createDataFrame([], f"{path_column} string" if path_column else "value string")
    options = {"rowTag": "__record", "ignoreNamespace": "true", "attributePrefix": "@", "valueTag": "@_VALUE", "inferSchema": "false"}
    # The columns follow from one record of each structure; each record is parsed once, where it lies.
    schema = spark.read.format("xml").options(**options, multiLine="false").load(shapes).schema
    # from_xml takes the column of what is no XML for the last one.
    corrupt = spark.conf.get("spark.sql.columnNameOfCorruptRecord")
    parsed = T.StructType(sorted(schema, key=lambda f: f.name == corrupt))
    raw = records.select(F.from_xml(as_element(F.col("body")), parsed, options).alias("r"), "file")
    raw = raw.select(*[F.col("file").alias(f.name) if f.name == f"@{FILE}" else F.col("r").getField(f.name).alias(f.name) for f in schema])
    if _holds_array(raw.schema):  # looked through before it is spread
        raw = materialise(raw, "xml-rows")
    rows = flattened(_spread(raw), mark="@")
    return rows.withColumnRenamed(FILE, path_column) if path_column else rows.drop(FILE)


def _spread(df: DataFrame) -> DataFrame:
    """Repeated elements as columns: by their one naming attribute, else by position."""
    while True:
        arrays = [f for f in df.schema if isinstance(f.dataType, T.ArrayType)]
        nested = [f for f in df.schema if isinstance(f.dataType, T.StructType) and _holds_array(f.dataType)]
        if not arrays and not nested:
            return df
        if nested:
            df = df.select(*[
                c for f in df.schema for c in (
                    [q(f.name).getField(g.name).alias(f"{f.name}.{g.name}") for g in f.dataType] if f in nested else [q(f.name)]
                )
            ])
            continue
        keyed = {f.name: _naming_field(f.dataType.elementType) for f in arrays}
        checks = []
        for i, f in enumerate(arrays):
            checks.append(F.max(F.size(q(f.name))).alias(f"n{i}"))
            if keyed[f.name]:
                names = q(f.name).getField(keyed[f.name])
                distinct = F.size(F.array_distinct(names)) == F.size(names)
                checks.append(F.bool_and(F.coalesce(distinct, F.lit(True))).alias(f"d{i}"))
                checks.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(names)))).alias(f"k{i}"))
        row = df.agg(*checks).first()
        out = []
        for f in df.schema:
            if f not in arrays:
                out.append(q(f.name))
                continue
            i = arrays.index(f)
            if keyed[f.name] and row[f"d{i}"]:
                pairs = F.map_from_arrays(q(f.name).getField(keyed[f.name]), q(f.name).getField("@_VALUE"))
                prefix = f.name.rsplit(".", 1)[0] + "." if "." in f.name else ""
                out += [F.try_element_at(pairs, F.lit(k)).alias(f"{prefix}{k}") for k in row[f"k{i}"]]
            else:
                n = max(row[f"n{i}"] or 1, 1)
                out += [
                    F.get(q(f.name), F.lit(j)).alias(f.name if j == 0 else f"{f.name}_{j + 1}") for j in range(n)
                ]
        df = df.select(*out)


def _holds_array(t: T.StructType) -> bool:
    return any(
        isinstance(f.dataType, T.ArrayType) or (isinstance(f.dataType, T.StructType) and _holds_array(f.dataType))
        for f in t
    )


def _naming_field(t: T.DataType) -> str | None:
    if not isinstance(t, T.StructType):
        return None
    attributes = [n for n in t.fieldNames() if n.startswith("@") and n != "@_VALUE"]
    return attributes[0] if len(attributes) == 1 and set(t.fieldNames()) <= {attributes[0], "@_VALUE"} else None


# -- Any format ------------------------------------------------------------

FORMATS = {
    "csv": "csv", "dat": "csv", "tsv": "tsv", "txt": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl",
    "xml": "xml", "parquet": "parquet", "orc": "orc",
}


def read_files(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None,
               path_column: str | None = None) -> DataFrame:
    """Files of one format as one table, by format name or file extension.

    ``path_column`` keeps the file of each row.
    """
    if fmt is None:
        name = path if isinstance(path, str) else path[0]
        fmt = FORMATS.get(name.rsplit(".", 1)[-1].lower())
    readers = {
        "csv": lambda: read_delimited(spark, path, path_column=path_column),
        "tsv": lambda: read_delimited(spark, path, "\t", path_column=path_column),
        "json": lambda: read_json(spark, path, path_column), "xml": lambda: read_xml(spark, path, path_column=path_column),
        "jsonl": lambda: flattened(_with_path(spark.read.json(path), path_column)),
        "parquet": lambda: _with_path(spark.read.format("parquet").load(path), path_column),
        "orc": lambda: _with_path(spark.read.format("orc").load(path), path_column),
    }
    if fmt not in readers:
        raise ValueError(f"unsupported file format: {fmt}")
    with few_listing_tasks(spark):
        return readers[fmt]()


def validate_files(spark: SparkSession, path: str | Sequence[str], fmt: str,
                   expected: dict[str, str] | None = None) -> DataFrame:
    """Problems of files that should parse as ``fmt`` and hold the expected columns.

    Text formats are parsed to the end and count as columns of strings; columnar
    ones answer from their footers.
    """
    if fmt not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"unsupported file format: {fmt}")
    text = fmt in ("csv", "json")
    try:
        df = spark.read.option("mode", "FAILFAST").option("header", True).format(fmt).load(path)
        if text:
            df.write.format("noop").mode("overwrite").save()
        else:
            df.count()
    except Exception as error:
        return spark.createDataFrame(
            [("", "parse_error", fmt, type(error).__name__)],
            "column_name string, problem string, expected_type string, actual_type string",
        )
    shape = df.select(*[q(c).cast("string").alias(c) for c in df.columns]) if text else df
    return expected_schema_diff(shape, expected if expected is not None else {f.name: f.dataType.simpleString() for f in shape.schema})


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Shards, sheets or pages under one set of columns, blank where a part lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def literal_rows(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """A few rows given in the job itself, as a table."""
    names = list(dict.fromkeys(k for row in rows for k in row))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names)


def read_jdbc(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              partitions: int = 1, fetch_size: int = 10_000) -> DataFrame:
    """A database query; with a partition column its ranges are read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is None:
        return reader.option("query", query).load()
    return (
        reader.option("dbtable", f"({query}) t").option("partitionColumn", partition_column)
        .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load()
    )


def read_query(spark: SparkSession, sql: str, params: dict | None = None) -> DataFrame:
    """Catalog SQL with bound ``:name`` parameters."""
    return spark.sql(sql, args=params or {})


def preview(df: DataFrame, limit: int | None = 20, most: int = 200) -> DataFrame:
    """The first rows; a limit above ``most`` is refused, None means all rows."""
    if limit is None:
        return df
    if not 1 <= limit <= most:
        raise ValueError(f"a preview has 1 to {most} rows")
    return df.limit(limit)
