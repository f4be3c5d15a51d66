"""Instruction documents from a snippet catalogue and a selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.defaults import CUSTOM
from folioflow.functions.text import let, split_lines, strip
from folioflow.operators.skew import lookup_join, skew_join

_ITEM = ["category", "name"]


def merge_defaults(loaded: DataFrame, defaults: DataFrame, owner: Sequence[str] = ()) -> DataFrame:
    """Bring stored catalogues up to date with the defaults.

    `loaded` holds (owner…, category, name, text). Missing categories and items
    are added, texts that differ are replaced, `Custom` is never overwritten and
    the owner's own items stay. `change` says what happened to each item.
    """
    owner = list(owner)
    standard = defaults.select("category", "name", F.col("text").alias("default_text"))
    if owner:
        # The defaults are configuration: one short list carried to every owner.
        rows = [tuple(r) for r in standard.collect()]
        listed = F.array(*[
            F.struct(F.lit(c).alias("category"), F.lit(n).alias("name"), F.lit(t).alias("default_text")) for c, n, t in rows
        ])
        standard = loaded.select(*owner).distinct().select(*owner, F.inline(listed))
    present = loaded.select(*owner, "category").distinct().withColumn("_has_category", F.lit(True))
    both = loaded.withColumn("_loaded", F.lit(True)).join(
        standard.withColumn("_default", F.lit(True)), [*owner, *_ITEM], "full"
    )
    both = skew_join(both, present, [*owner, "category"], "left", ["name"])

    custom, has = F.col("name") == CUSTOM, F.coalesce(F.col("_has_category"), F.lit(False))
    is_loaded, is_default = F.col("_loaded").isNotNull(), F.col("_default").isNotNull()
    differs = ~F.col("text").eqNullSafe(F.col("default_text"))
    return both.select(
        *owner,
        *_ITEM,
        F.when(is_loaded & (custom | ~is_default), F.col("text"))
        .when(~is_loaded & custom & has, F.lit(""))
        .otherwise(F.col("default_text"))
        .alias("text"),
        F.when(~is_loaded, "added")
        .when(~is_default, "user")
        .when(~custom & differs, "updated")
        .otherwise("kept")
        .alias("change"),
    )


def was_updated(merged: DataFrame, owner: Sequence[str]) -> DataFrame:
    return merged.groupBy(*owner).agg(F.bool_or(F.col("change").isin("added", "updated")).alias("was_updated"))


def _known(selection: DataFrame, catalogue: DataFrame, how: str) -> DataFrame:
    return lookup_join(selection, catalogue.select(*_ITEM).distinct(), _ITEM, how, ["prompt_id"])


def validate_selection(selection: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Selected snippets with the reason each one is refused, null when it is valid."""
    categories = catalogue.select("category").distinct().withColumn("_category", F.lit(True))
    items = catalogue.select(*_ITEM).distinct().withColumn("_item", F.lit(True))
    tagged = lookup_join(selection, categories, ["category"], "left", ["prompt_id"])
    tagged = lookup_join(tagged, items, _ITEM, "left", ["prompt_id"])
    no_text = F.col("custom_text").isNull() | (F.col("custom_text") == "")
    reason = (
        F.when(F.col("_category").isNull(), "unknown category")
        .when((F.col("name") == CUSTOM) & no_text, "custom without text")
        .when((F.col("name") != CUSTOM) & F.col("_item").isNull(), "unknown name")
    )
    return tagged.withColumn("reason", reason).drop("_category", "_item")


def snippet_text(selection: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Text of each selected snippet, with `problem` where there is none."""
    texts = catalogue.select(*_ITEM, "text", F.lit(True).alias("_defined"))
    joined = lookup_join(selection, texts, _ITEM, "left", ["prompt_id"])
    problem = F.when(F.col("name") != CUSTOM, F.when(F.col("_defined").isNull(), "definition missing").when(
        F.coalesce("text", F.lit("")) == "", "empty text"))
    return joined.withColumn("problem", problem).drop("_defined")


def _asked(question_selection: DataFrame) -> DataFrame:
    """Each question once per prompt; a null text stands for a prompt that asks nothing."""
    return question_selection.filter(F.col("text").isNotNull()).select("prompt_id", "text").distinct()


def selected_questions(question_selection: DataFrame, questions: DataFrame) -> DataFrame:
    """Known questions among the selected ones, with their catalogue position."""
    asked = _asked(question_selection)
    return lookup_join(asked, questions, ["text"], "inner", ["prompt_id"])


def intersect_known(question_selection: DataFrame, questions: DataFrame) -> DataFrame:
    asked = _asked(question_selection)
    return lookup_join(asked, questions.select("text").distinct(), ["text"], "left_semi", ["prompt_id"])


def unknown_questions(question_selection: DataFrame, questions: DataFrame) -> DataFrame:
    asked = _asked(question_selection)
    return lookup_join(asked, questions.select("text").distinct(), ["text"], "left_anti", ["prompt_id"])


def catalogue_order(catalogue: DataFrame) -> DataFrame:
    """Items in definition order, `Custom` last in its category."""
    return catalogue.orderBy("cat_pos", F.col("name") == CUSTOM, "item_pos")


def build_instructions(
    selection: DataFrame,
    catalogue: DataFrame,
    question_selection: DataFrame | None = None,
    questions: DataFrame | None = None,
) -> DataFrame:
    """One `<instructions>` document per prompt.

    A selection names each snippet once per prompt (the last custom text wins),
    and unknown names carry no text, so what is gathered per prompt is bounded
    by the catalogue.
    """
    once = selection.groupBy("prompt_id", *_ITEM).agg(
        F.min("sel_pos").alias("sel_pos"), F.max_by("custom_text", "sel_pos").alias("custom_text")
    )
    order = catalogue.groupBy("category").agg(F.min("cat_pos").alias("cat_pos"))
    texts = catalogue.select(*_ITEM, "text")
    placed = lookup_join(once, order, ["category"], "inner", ["prompt_id"])
    placed = lookup_join(placed, texts, _ITEM, "left", ["prompt_id"])

    indented = F.array_join(
        F.transform(split_lines(strip(F.col("custom_text"))), lambda line: F.concat(F.lit("        "), line)), "\n"
    )
    line = F.when(
        F.col("name") == CUSTOM, F.when(F.coalesce("custom_text", F.lit("")) != "", indented)
    ).when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("        "), F.col("text")))
    tag = F.lower(F.replace(F.col("category"), F.lit(" "), F.lit("_")))
    # collect_list leaves out items without a line; the tag pair stays.
    blocks = placed.withColumn("_line", line).groupBy("prompt_id", "category", "cat_pos").agg(
        F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("sel_pos", "_line")))).alias("_items")
    )
    block = let(
        F.transform(F.col("_items"), lambda i: i["_line"]),
        lambda lines: F.array_join(
            F.concat(
                F.array(F.concat(F.lit("    <"), tag, F.lit(">"))), lines,
                F.array(F.concat(F.lit("    </"), tag, F.lit(">"))),
            ),
            "\n",
        ),
    )
    ordered = blocks.select("prompt_id", F.col("cat_pos").cast("long").alias("_pos"), block.alias("_block"))
    if question_selection is not None and questions is not None:
        ordered = ordered.union(_question_blocks(question_selection, questions))
    everyone = selection.select("prompt_id")
    if question_selection is not None:
        everyone = everyone.union(question_selection.select("prompt_id"))
    documents = ordered.groupBy("prompt_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_block"))), lambda b: b["_block"]), "\n").alias("_body")
    )
    return everyone.distinct().join(documents, "prompt_id", "left").select(
        "prompt_id",
        F.concat_ws("\n", F.lit("<instructions>"), F.col("_body"), F.lit("</instructions>")).alias("instructions"),
    )


def _question_blocks(question_selection: DataFrame, questions: DataFrame) -> DataFrame:
    asked = _asked(question_selection)
    known = lookup_join(asked, questions, ["text"], "left", ["prompt_id"])
    listed = known.groupBy("prompt_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "text")))).alias("_asked")
    )
    lines = F.transform(F.col("_asked"), lambda q: F.concat(F.lit("        "), q["text"]))
    tags = F.concat(F.array(F.lit("    <questions>")), lines, F.array(F.lit("    </questions>")))
    last = F.lit(2**62).cast("long")
    return listed.select("prompt_id", last.alias("_pos"), F.array_join(tags, "\n").alias("_block"))
