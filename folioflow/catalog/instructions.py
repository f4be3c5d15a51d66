"""Queries of snippets, questions and instruction documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.catalog import fixtures as fx
from folioflow.catalog import sqltext as q
from folioflow.catalog.registry import query
from folioflow.defaults import CATEGORIES, QUESTIONS, SNIPPETS
from folioflow.operators import instructions as I
from folioflow.operators.skew import running_rank
from folioflow.sources.tables import default_questions, default_snippets, parse_snippets


def _values(rows: list[tuple], name: str, columns: str) -> str:
    text = ", ".join("(" + ", ".join(q.quoted(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"{name} AS (SELECT * FROM (VALUES {text}) t({columns}))"


_seen: dict[str, int] = {}
_ROWS = []
for _c, _n, _t in SNIPPETS:
    _seen[_c] = _seen.get(_c, -1) + 1
    _ROWS.append((_c, CATEGORIES.index(_c), _n, _seen[_c], _t))
CATALOGUE = _values(_ROWS, "catalogue", "category, cat_pos, name, item_pos, text")
ASKABLE = _values(list(enumerate(QUESTIONS)), "questions", "pos, text")

_CATEGORY_LIST = "[" + ", ".join(q.quoted(c) for c in CATEGORIES) + "]"
_QUESTION_LIST = "[" + ", ".join(q.quoted(t) for t in [*QUESTIONS, "Is anybody there?"]) + "]"

# Per document: its text as custom text, one output format (or an unknown one), and a known or unknown extra.
SELECTION = f"""selection AS (
SELECT CAST(doc_id AS VARCHAR) AS prompt_id, {_CATEGORY_LIST}[CAST(doc_id % 6 + 1 AS BIGINT)] AS category, 'Custom' AS name, 0 AS sel_pos,
  CASE WHEN doc_id % 11 = 5 THEN '' ELSE text END AS custom_text FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'Output', ['JSON Diff', 'MD Diff', 'Nonsense'][CAST(doc_id % 3 + 1 AS BIGINT)], 1, NULL FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN 'Objective' ELSE 'Elsewhere' END, 'Split File', 2, NULL FROM documents)"""
ASKED = f"asked AS (SELECT CAST(doc_id AS VARCHAR) AS prompt_id, CASE WHEN lang <> 'de' THEN {_QUESTION_LIST}[CAST(doc_id % 4 + 1 AS BIGINT)] END AS text FROM documents)"


def selection(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("doc_id")

    def pick(values: list[str], modulus: int):
        return F.element_at(F.array(*map(F.lit, values)), (n % modulus + 1).cast("int"))

    none = F.lit(None).cast("string")
    rows = fx.rows_of(
        ["category", "name", "sel_pos", "custom_text"],
        (pick(CATEGORIES, 6), "Custom", 0, F.when(n % 11 == 5, "").otherwise(F.col("text"))),
        ("Output", pick(["JSON Diff", "MD Diff", "Nonsense"], 3), 1, none),
        (F.when(n % 2 == 0, "Objective").otherwise("Elsewhere"), "Split File", 2, none),
    )
    return fx.table(spark, folder, "documents").select(n.cast("string").alias("prompt_id"), F.inline(rows))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """One question a document, none for German ones."""
    text = F.element_at(F.array(*map(F.lit, [*QUESTIONS, "Is anybody there?"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return fx.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("prompt_id"), F.when(F.col("lang") != "de", text).alias("text")
    )


def _documents_sql(chosen: str, questions: str) -> str:
    """Instruction documents from the named selection and question tables."""
    indent = "'        '"
    custom = f"array_to_string(list_transform(string_split({q.strip('s.custom_text')}, chr(10)), lambda l: {indent} || l), chr(10))"
    return f"""lines AS (SELECT s.prompt_id, s.category, c.cat_pos, s.sel_pos, CASE WHEN s.name = 'Custom' THEN CASE WHEN s.custom_text <> '' THEN {custom} END
    WHEN t.text <> '' THEN {indent} || t.text END AS line
  FROM {chosen} s JOIN (SELECT category, min(cat_pos) AS cat_pos FROM catalogue GROUP BY category) c USING (category)
  LEFT JOIN catalogue t ON t.category = s.category AND t.name = s.name),
blocks AS (SELECT prompt_id, CAST(cat_pos AS BIGINT) AS pos, '    <' || replace(lower(category), ' ', '_') || '>' || chr(10) ||
    coalesce(string_agg(line, chr(10) ORDER BY sel_pos) || chr(10), '') || '    </' || replace(lower(category), ' ', '_') || '>' AS block
  FROM lines GROUP BY prompt_id, category, cat_pos
  UNION ALL SELECT a.prompt_id, 1000000, '    <questions>' || chr(10) || coalesce(string_agg({indent} || k.text, chr(10) ORDER BY k.pos) || chr(10), '') || '    </questions>'
  FROM (SELECT DISTINCT prompt_id, text FROM {questions} WHERE text IS NOT NULL) a LEFT JOIN questions k USING (text) GROUP BY a.prompt_id),
instructions AS (SELECT prompt_id, '<instructions>' || chr(10) || string_agg(block, chr(10) ORDER BY pos) || chr(10) || '</instructions>' AS instructions
  FROM blocks GROUP BY prompt_id)"""


@query("build_instructions", f"WITH {CATALOGUE}, {ASKABLE}, {SELECTION}, {ASKED}, {_documents_sql('selection', 'asked')} SELECT * FROM instructions")
def build_instructions(spark: SparkSession, folder: str) -> DataFrame:
    return I.build_instructions(selection(spark, folder), default_snippets(spark), asked(spark, folder), default_questions(spark))


# One prompt per project: an objective, a custom scope that names the project, and one question.
INSTRUCTIONS_SQL = f"""{CATALOGUE}, {ASKABLE},
chosen_snippets AS (SELECT DISTINCT source AS prompt_id, unnest(['Objective', 'Scope', 'Output']) AS category, unnest(['Split File', 'Custom', 'JSON Diff']) AS name,
  unnest([0, 1, 2]) AS sel_pos, unnest([NULL, ' Only ' || source || chr(10) || 'and nothing else ', NULL]) AS custom_text FROM documents),
asked_questions AS (SELECT DISTINCT source AS prompt_id, {q.quoted(QUESTIONS[1])} AS text FROM documents),
{_documents_sql('chosen_snippets', 'asked_questions')}"""


def project_instructions(spark: SparkSession, folder: str) -> DataFrame:
    projects = fx.table(spark, folder, "documents").select(F.col("source").alias("prompt_id")).distinct()
    none = F.lit(None).cast("string")
    scope = F.concat(F.lit(" Only "), "prompt_id", F.lit("\nand nothing else "))
    rows = fx.rows_of(
        ["category", "name", "sel_pos", "custom_text"],
        ("Objective", "Split File", 0, none), ("Scope", "Custom", 1, scope), ("Output", "JSON Diff", 2, none),
    )
    documents = I.build_instructions(
        projects.select("prompt_id", F.inline(rows)), default_snippets(spark),
        projects.select("prompt_id", F.lit(QUESTIONS[1]).alias("text")), default_questions(spark),
    )
    return documents.withColumnRenamed("prompt_id", "project_id")


@query("snippet_text", f"""WITH {CATALOGUE}, {SELECTION}
SELECT s.prompt_id, s.category, s.name, s.custom_text, c.text, CASE WHEN s.name <> 'Custom' THEN CASE WHEN c.name IS NULL THEN 'definition missing' WHEN c.text = '' THEN 'empty text' END END AS problem
FROM selection s LEFT JOIN catalogue c USING (category, name)""")
def snippet_text(spark: SparkSession, folder: str) -> DataFrame:
    return I.snippet_text(selection(spark, folder), default_snippets(spark)).select(
        "prompt_id", "category", "name", "custom_text", "text", "problem"
    )


@query("validate_selection", f"""WITH {CATALOGUE}, {SELECTION}
SELECT prompt_id, category, name, CASE WHEN category NOT IN (SELECT category FROM catalogue) THEN 'unknown category'
  WHEN name = 'Custom' AND coalesce(custom_text, '') = '' THEN 'custom without text'
  WHEN name <> 'Custom' AND (category, name) NOT IN (SELECT (category, name) FROM catalogue) THEN 'unknown name' END AS reason FROM selection""")
def validate_selection(spark: SparkSession, folder: str) -> DataFrame:
    return I.validate_selection(selection(spark, folder), default_snippets(spark)).select("prompt_id", "category", "name", "reason")


@query("selected_questions", f"WITH {ASKABLE}, {ASKED} SELECT prompt_id, text, pos FROM asked JOIN questions USING (text)")
def selected_questions(spark: SparkSession, folder: str) -> DataFrame:
    return I.selected_questions(asked(spark, folder), default_questions(spark)).select("prompt_id", "text", "pos")


@query("intersect_known", f"WITH {ASKABLE}, {ASKED} SELECT prompt_id, text FROM asked WHERE text IN (SELECT text FROM questions)")
def intersect_known(spark: SparkSession, folder: str) -> DataFrame:
    return I.intersect_known(asked(spark, folder), default_questions(spark))


@query("minus_unknown_questions", f"WITH {ASKABLE}, {ASKED} SELECT prompt_id, text FROM asked WHERE text NOT IN (SELECT text FROM questions)")
def minus_unknown_questions(spark: SparkSession, folder: str) -> DataFrame:
    return I.unknown_questions(asked(spark, folder), default_questions(spark))


# A stored catalogue per document: its text stands for an outdated, a custom or an own item.
_LOADED = """loaded AS (SELECT doc_id AS owner_id, 'Objective' AS category, CASE doc_id % 3 WHEN 0 THEN 'Split File' WHEN 1 THEN 'Custom' ELSE 'Mine' END AS name, text FROM documents
UNION ALL SELECT doc_id, 'Output', 'Full and Final', 'Return the full and final scripts that were added or modified.' FROM documents
UNION ALL SELECT doc_id, 'Own', 'Own', text FROM documents)"""
_MERGED = """standard AS (SELECT owner_id, category, name, text FROM (SELECT DISTINCT owner_id FROM loaded) CROSS JOIN catalogue),
merged AS (SELECT owner_id, category, name,
  CASE WHEN l.owner_id IS NULL THEN CASE WHEN name = 'Custom' AND (owner_id, category) IN (SELECT (owner_id, category) FROM loaded) THEN '' ELSE s.text END
    WHEN name = 'Custom' OR s.owner_id IS NULL THEN l.text ELSE s.text END AS text,
  CASE WHEN l.owner_id IS NULL THEN 'added' WHEN s.owner_id IS NULL THEN 'user' WHEN name <> 'Custom' AND l.text <> s.text THEN 'updated' ELSE 'kept' END AS change
FROM loaded l FULL JOIN standard s USING (owner_id, category, name))"""


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    n, text = F.col("doc_id"), F.col("text")
    name = F.when(n % 3 == 0, "Split File").when(n % 3 == 1, "Custom").otherwise("Mine")
    rows = fx.rows_of(
        ["category", "name", "text"],
        ("Objective", name, text), ("Own", "Own", text),
        ("Output", "Full and Final", "Return the full and final scripts that were added or modified."),
    )
    return fx.table(spark, folder, "documents").select(n.alias("owner_id"), F.inline(rows))


@query("merge_defaults", f"WITH {CATALOGUE}, {_LOADED}, {_MERGED} SELECT owner_id, category, name, text, change FROM merged")
def merge_defaults(spark: SparkSession, folder: str) -> DataFrame:
    return I.merge_defaults(_loaded(spark, folder), default_snippets(spark), ["owner_id"])


@query("merge_was_updated", f"""WITH {CATALOGUE}, {_LOADED}, {_MERGED}
SELECT owner_id, bool_or(change IN ('added', 'updated')) AS was_updated FROM merged GROUP BY owner_id""")
def merge_was_updated(spark: SparkSession, folder: str) -> DataFrame:
    merged = I.merge_defaults(_loaded(spark, folder), default_snippets(spark), ["owner_id"])
    return I.was_updated(merged, ["owner_id"])


# A settings document per conversation turn: two categories, one with the turn's text as an item.
@query("read_snippets", """
SELECT conv_id * 1000 + turn AS owner_id, unnest(['Zeta', 'Zeta', 'Alpha']) AS category, unnest([0, 0, 1]) AS cat_pos,
  unnest(['said', 'role', 'empty']) AS name, unnest([0, 1, 0]) AS item_pos, unnest([text, role, '']) AS text FROM conversations""")
def read_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Settings documents are written and read back; every other one has a broken twin that gives no rows."""
    items = F.create_map(
        F.lit("Zeta"), F.struct(F.create_map(F.lit("said"), "text", F.lit("role"), "role").alias("items")),
        F.lit("Alpha"), F.struct(F.create_map(F.lit("empty"), F.lit("")).alias("items")),
    )
    whole = F.to_json(F.struct(items.alias("prompt_snippets")))
    broken = F.substring(whole, F.lit(1), F.length(whole) - 5)
    settings = fx.table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("owner_id"), F.explode(F.array(whole, broken)).alias("settings")
    )
    return parse_snippets(settings)


@query("catalogue_order", f"""WITH {CATALOGUE}, {SELECTION}
SELECT prompt_id, category, name, row_number() OVER (PARTITION BY prompt_id ORDER BY cat_pos, name = 'Custom', item_pos) AS pos
FROM selection JOIN catalogue USING (category, name)""")
def catalogue_order(spark: SparkSession, folder: str) -> DataFrame:
    """Known selected items of each prompt in catalogue order."""
    catalogue = I.catalogue_order(default_snippets(spark)).select("category", "name", "cat_pos", "item_pos")
    placed = selection(spark, folder).join(F.broadcast(catalogue), ["category", "name"]).withColumn("_last", F.col("name") == "Custom")
    return running_rank(placed.drop("custom_text"), ["prompt_id"], ["cat_pos", "_last", "item_pos"], "pos").select("prompt_id", "category", "name", "pos")
