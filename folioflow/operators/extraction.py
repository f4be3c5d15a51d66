"""Model responses to change records."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.defaults import FENCED_JSON, MARKDOWN_DIFF, MARKDOWN_PROPOSED
from folioflow.functions.hunks import diff_text_changes, line_changes
from folioflow.functions.paths import resolve_path
from folioflow.functions.text import is_blank, let, once, strip


def live_responses(responses: DataFrame) -> DataFrame:
    """Responses that hold any text."""
    return responses.filter(F.col("text").isNotNull() & ~is_blank(F.col("text")))


def _bounds(text: Column, opening: str, closing: str) -> Column:
    """Struct (start, end) of the outermost bracket pair, 1-based; start 0 if there is none."""
    start = F.instr(text, opening)
    from_end = F.instr(F.reverse(text), closing)
    end = F.when(from_end > 0, F.length(text) - from_end + 1).otherwise(0)
    paired = (start > 0) & (end > start)
    return F.struct(F.when(paired, start).otherwise(0).alias("start"), end.alias("end"))


def json_segment(text: Column) -> Column:
    """The part of a response to read as JSON: a fenced block, else the outermost brackets."""
    whole = let(
        F.struct(_bounds(text, "{", "}").alias("obj"), _bounds(text, "[", "]").alias("arr")),
        lambda b: let(
            F.when(
                (b["arr"]["start"] > 0) & ((b["obj"]["start"] == 0) | (b["arr"]["start"] < b["obj"]["start"])), b["arr"]
            ).otherwise(b["obj"]),
            lambda span: F.when(
                span["start"] > 0, F.substring(text, span["start"], span["end"] - span["start"] + F.lit(1))
            ),
        ),
    )
    return F.when(text.rlike(FENCED_JSON), strip(F.regexp_extract(text, FENCED_JSON, 1))).otherwise(whole)


# Rows of a batch that are Python objects at a time.
ROWS_AT_ONCE = 100


def _by_rows(texts: pa.Array, read: Callable[[str | None], object], type_: pa.DataType) -> pa.Array:
    """`read` of each text. Texts and results are Arrow arrays but for a few rows, so a worker needs little memory beside the batch."""
    parts = [
        pa.array([read(t) for t in texts.slice(at, ROWS_AT_ONCE).to_pylist()], type_) for at in range(0, len(texts), ROWS_AT_ONCE)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], type_)


@F.arrow_udf(T.StringType())
def _reprint_json(texts: pa.Array) -> pa.Array:
    """JSON that only a lenient reader accepts, printed plainly; null if unreadable.

    The last of repeated keys wins, numbers that aren't finite become null, and
    lone surrogates stay escapes, as Arrow can't carry them.
    """

    def nothing(_: str) -> None:
        return None

    def reprint(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text, parse_constant=nothing), allow_nan=False)
        except (ValueError, RecursionError):
            return None

    return _by_rows(texts, reprint, pa.string())


_ITEM_TYPE = (
    "array<struct<file:string,is_hunk:boolean,hunk_lines:array<string>,"
    "context_before:array<string>,context_after:array<string>,diff_text:string,proposed_content:string>>"
)


def _field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _strings(value: Column) -> Column:
    """The value as strings if it is a list of nothing but strings, else null."""
    listed = F.try_variant_get(value, "$", "array<string>")
    plain = _kind(value).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(listed, lambda s: s.isNull())
    return F.when(plain, listed)


def _is_empty(value: Column) -> Column:
    """Missing, null, false, zero, or an empty string, list or object."""
    return value.isNull() | F.to_json(value).isin("null", "false", "0", "0.0", '""', "[]", "{}")


def _item(item: Column) -> Column:
    def build(f: Column) -> Column:
        hunk = F.when(_is_empty(f["hunk"]), f["hunk_lines"]).otherwise(f["hunk"])
        lines = _strings(hunk)
        text = {
            name: F.when(_kind(f[name]) == "STRING", F.try_variant_get(f[name], "$", "string"))
            for name in ("file", "diff", "proposed_content")
        }
        return F.struct(
            F.when(text["file"] != "", text["file"]).alias("file"),
            lines.isNotNull().alias("is_hunk"),
            lines.alias("hunk_lines"),
            F.coalesce(_strings(f["context_before"]), F.array().cast("array<string>")).alias("context_before"),
            F.coalesce(_strings(f["context_after"]), F.array().cast("array<string>")).alias("context_after"),
            text["diff"].alias("diff_text"),
            text["proposed_content"].alias("proposed_content"),
        )

    names = ["file", "hunk", "hunk_lines", "context_before", "context_after", "diff", "proposed_content"]
    return let(F.struct(*[_field(item, n).alias(n) for n in names]), build)


def json_items(document: Column) -> Column:
    """Valid change records of a parsed response; items of the wrong shape are passed by."""
    kind = _kind(document)
    listed = F.when(kind.startswith("ARRAY"), F.try_variant_get(document, "$", "array<variant>")).when(
        kind.startswith("OBJECT"), F.array(document)
    )
    items = F.transform(F.filter(listed, lambda i: _kind(i).startswith("OBJECT")), _item)
    usable = F.filter(
        items,
        lambda i: i["file"].isNotNull()
        & (i["is_hunk"] | i["diff_text"].isNotNull() | i["proposed_content"].isNotNull()),
    )
    return F.coalesce(usable, F.array().cast(_ITEM_TYPE))


def looks_like_json(text: Column) -> Column:
    space = r"[\s\x1c-\x1f]*"

    def enclosed(opening: str, closing: str) -> Column:
        return text.rlike(rf"(?U)\A{space}\{opening}") & text.rlike(rf"(?U)\{closing}{space}\z")

    return enclosed("{", "}") | enclosed("[", "]") | text.contains("```json")


def legacy_format(text: Column) -> Column:
    return (
        F.when(text.contains("<diff file=") | text.contains("<proposed_content file="), "xml")
        .when(text.contains("```diff file=") & text.contains('type="proposed"'), "markdown")
        .otherwise("unknown")
    )


def detect_format(text: Column) -> Column:
    """What a response looks like, before it is read."""
    return F.when(looks_like_json(text), "json").otherwise(legacy_format(text))


def with_format(responses: DataFrame, beside: dict[str, Column] | None = None) -> DataFrame:
    """Adds `format` and the JSON `items`; JSON without a valid item falls through to the older formats.

    Columns `beside` are made where the lenient reader runs: what they need of Python is the same worker.
    """
    segment = F.when(looks_like_json(F.col("text")), json_segment(F.col("text")))
    parsed = responses.withColumn("_segment", once(segment)).withColumn("_strict", once(F.try_parse_json("_segment")))
    parsed = parsed.withColumns({"_reprinted": _reprint_json(F.when(F.col("_strict").isNull(), F.col("_segment"))), **(beside or {})})
    items = json_items(F.coalesce(F.col("_strict"), F.try_parse_json("_reprinted")))
    return parsed.withColumn("items", once(items)).withColumn(
        "format", F.when(F.size("items") > 0, "json").otherwise(legacy_format(F.col("text")))
    ).drop("_segment", "_strict", "_reprinted")


_PIECES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "file", "body")]))


_XML_ARROW = pa.struct([
    ("error", pa.string()), ("pieces", pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "file", "body")])))
])


@F.arrow_udf(T.StructType([T.StructField("error", T.StringType()), T.StructField("pieces", _PIECES)]))
def _xml_pieces(texts: pa.Array) -> pa.Array:
    """Tagged bodies of an XML response, in document order, or the parse error."""

    def read(text: str | None) -> dict:
        if text is None:
            return {"error": None, "pieces": []}
        try:
            root = ET.fromstring(f"<root>{text}</root>")
        except ET.ParseError as error:
            return {"error": str(error), "pieces": []}
        tags = {"diff": "diff", "proposed_content": "proposed"}
        pieces = [
            {"kind": tags[e.tag], "file": e.get("file"), "body": (e.text or "").strip()}
            for e in root.iter()
            if e.tag in tags and e.get("file")
        ]
        return {"error": None, "pieces": pieces}

    return _by_rows(texts, read, _XML_ARROW)


def markdown_pieces(text: Column) -> Column:
    """Fenced diff and proposed blocks: array of (kind, file, body)."""

    def blocks(kind: str, pattern: str) -> Column:
        def group(n: int) -> Column:
            return F.regexp_extract_all(text, F.lit(pattern), F.lit(n))

        return F.transform(
            F.arrays_zip(group(2).alias("file"), group(3).alias("body")),
            lambda b: F.struct(F.lit(kind).alias("kind"), b["file"].alias("file"), strip(b["body"]).alias("body")),
        )

    return F.concat(blocks("diff", MARKDOWN_DIFF), blocks("proposed", MARKDOWN_PROPOSED))


def pair_diff_proposed(pieces: DataFrame) -> DataFrame:
    """Diff and proposed content of one path as one suggestion; the last of each wins.

    `pieces` holds (response_id, project_id, rel_path, kind, body, pos).
    Content without a diff is a new-file suggestion with an empty diff.
    """
    # A newer position replaces an older one in the map-side aggregate already.
    def last(kind: str) -> Column:
        mine = F.col("kind") == kind
        return F.max_by(F.when(mine, F.col("body")), F.when(mine, F.col("pos")))

    return (
        pieces.groupBy("response_id", "project_id", "rel_path")
        .agg(last("diff").alias("diff_text"), last("proposed").alias("proposed_content"))
        .fillna("", ["diff_text"])
    )


def last_per_path(pieces: DataFrame) -> DataFrame:
    """The last body of each kind that a response gives for a path."""
    return pieces.groupBy("response_id", "project_id", "rel_path", "kind").agg(
        F.max_by("body", "pos").alias("body"), F.count("*").alias("n_given")
    )


def resolve_paths(changes: DataFrame, raw: str = "file") -> DataFrame:
    """Adds `rel_path` and `path_problem` (null when the path is safe)."""
    resolved = changes.withColumn("_path", resolve_path(F.col(raw)))
    return resolved.withColumns(
        {"rel_path": F.col("_path.rel_path"), "path_problem": F.col("_path.reason")}
    ).drop("_path")


def path_ok(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("path_problem").isNull())


def _record(kind: str | Column, file: Column, **fields: Column) -> Column:
    strings = F.lit(None).cast("array<string>")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        kind.alias("kind"), file.alias("file"),
        *[fields.get(name, strings).alias(name) for name in ("hunk_lines", "context_before", "context_after")],
        fields.get("body", F.lit(None).cast("string")).alias("body"),
    )


def _item_records(item: Column) -> Column:
    """A hunk, or the diff and the content of a whole-file suggestion."""
    arrays = {name: item[name] for name in ("hunk_lines", "context_before", "context_after")}
    pieces = F.array(
        _record("diff", item["file"], body=strip(item["diff_text"])),
        _record("proposed", item["file"], body=item["proposed_content"]),
    )
    return F.when(item["is_hunk"], F.array(_record("hunk", item["file"], **arrays))).otherwise(
        F.filter(pieces, lambda p: p["body"].isNotNull())
    )


def change_records(responses: DataFrame) -> DataFrame:
    """Everything the responses hold, in one pass and one flat table.

    One row per hunk, diff, proposed content or parse error (`kind`), with its
    place in the response, its safe `rel_path`, and `path_problem` if the path
    leaves the project.
    """
    # Whatever may turn out to be XML is read as such, before its JSON is known to hold no items.
    maybe = _xml_pieces(F.when(legacy_format(F.col("text")) == "xml", F.col("text")))
    read = with_format(live_responses(responses), {"_xml": maybe})
    is_xml = F.col("format") == "xml"
    pieces = F.when(is_xml, F.col("_xml.pieces")).when(
        F.col("format") == "markdown", markdown_pieces(F.col("text"))
    )
    named = F.filter(pieces, lambda p: p["file"] != "")
    error = F.when(is_xml & F.col("_xml.error").isNotNull(), F.array(_record("error", F.lit(None).cast("string"), body=F.col("_xml.error"))))
    numbered_items = F.flatten(F.transform(
        F.col("items"),
        lambda item, i: F.transform(_item_records(item), lambda r: F.struct(i.alias("pos"), r.alias("record"))),
    ))
    numbered_pieces = F.transform(
        F.coalesce(error, F.transform(named, lambda p: _record(p["kind"], p["file"], body=p["body"]))),
        lambda r, i: F.struct(i.alias("pos"), r.alias("record")),
    )
    rows = F.when(F.col("format") == "json", numbered_items).otherwise(numbered_pieces)
    flat = read.select("response_id", "project_id", "format", F.explode(once(rows)).alias("_row"))
    flat = flat.select("response_id", "project_id", "format", F.col("_row.pos").cast("long").alias("pos"), "_row.record.*")
    return resolve_paths(flat)


class Extracted:
    """Hunks, suggestions, rejects and parse errors as views of one table of change records."""

    def __init__(self, records: DataFrame):
        self.records = records

    def _pieces(self) -> DataFrame:
        return path_ok(self.records.filter(F.col("kind").isin("diff", "proposed")))

    @property
    def hunks(self) -> DataFrame:
        """Hunks with a safe path, numbered by their place in the response."""
        counts = line_changes(F.col("hunk_lines"))
        return path_ok(self.records.filter(F.col("kind") == "hunk")).select(
            "response_id", F.col("pos").alias("hunk_pos"), "project_id", "rel_path",
            "hunk_lines", "context_before", "context_after",
            counts["added"].alias("lines_added"), counts["deleted"].alias("lines_deleted"),
        )

    @property
    def suggestions(self) -> DataFrame:
        counts = diff_text_changes(F.col("diff_text"))
        return pair_diff_proposed(self._pieces()).withColumns(
            {"lines_added": counts["added"], "lines_deleted": counts["deleted"]}
        )

    @property
    def rejects(self) -> DataFrame:
        """Changes with an unsafe path, and why."""
        bad = self.records.filter(F.col("path_problem").isNotNull() & (F.col("kind") != "error"))
        return bad.select("response_id", "project_id", "file", "path_problem")

    @property
    def errors(self) -> DataFrame:
        return self.records.filter(F.col("kind") == "error").select(
            "response_id", "project_id", F.col("body").alias("parse_error")
        )


def extract_changes(responses: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> Extracted:
    """Change records of responses. `keep` (a checkpoint, say) saves reading them again for each view."""
    records = change_records(responses)
    return Extracted(keep(records) if keep else records)


def union_changes(hunks: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Hunks and suggestions as one table with a `kind` column."""
    return hunks.withColumn("kind", F.lit("hunk")).unionByName(
        suggestions.withColumn("kind", F.lit("suggestion")), allowMissingColumns=True
    )
