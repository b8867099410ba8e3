"""Model input texts, one expression per published format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxon.functions.text import filled, strip

# The wording of the formats.
TASK_SUFFIX = "Task: Classify cultural specificity as agnostic, representative, or exclusive."
TEMPLATE_HEAD = "Classify the cultural specificity of this item:"
TYPE_GLOSS = {
    "entity": "Named Entity (specific instance)",
    "concept": "General Concept (abstract/general)",
}
OPTIONAL_FIELDS = ("Description", "Type", "Category", "Subcategory")


def _tagged(tag: str, value: Column) -> Column:
    return F.concat(F.lit(f"{tag}: "), value)


def prompt_plain(name: Column, description: Column) -> Column:
    """``name. description`` without outer white space."""
    return strip(F.concat(filled(name), F.lit(". "), filled(description)))


def _fields(name: Column, values: list[Column], present) -> Column:
    parts = [_tagged("Item", filled(name))]
    # concat_ws leaves NULL parts out, so an absent field needs no branch of its own
    parts += [F.when(present(v), _tagged(tag, v)) for tag, v in zip(OPTIONAL_FIELDS, values)]
    return F.concat(F.concat_ws(". ", *parts), F.lit("."))


def prompt_fields(name: Column, description: Column, type_: Column, category: Column, subcategory: Column) -> Column:
    """Tagged fields joined by ``. ``; empty ones are left out."""
    return _fields(name, [description, type_, category, subcategory], lambda v: v != "")


def prompt_fields_lenient(
    name: Column, description: Column, type_: Column, category: Column, subcategory: Column
) -> Column:
    """As ``prompt_fields``, but NULL and blank fields are left out as well."""
    return _fields(name, [description, type_, category, subcategory], lambda v: strip(v) != "")


def prompt_template(name: Column, description: Column, category: Column, type_: Column) -> Column:
    """Fixed lines; every field is printed, a missing one empty."""
    lines = [
        F.lit(TEMPLATE_HEAD),
        _tagged("Name", filled(name)),
        _tagged("Description", filled(description)),
        _tagged("Category", filled(category)),
        _tagged("Type", filled(type_)),
    ]
    return strip(F.concat_ws("\n", *lines))


def reach_tag(languages: Column) -> Column:
    """Marker for very wide, wide and narrow language coverage; NULL in between."""
    count = languages.cast("string")
    return (
        F.when(languages > 50, F.lit("[Global reach: 50+ languages]"))
        .when(languages > 20, F.concat(F.lit("[International: "), count, F.lit(" languages]")))
        .when((languages > 0) & (languages < 5), F.concat(F.lit("[Regional: "), count, F.lit(" languages]")))
    )


def prompt_enhanced(
    name: Column,
    description: Column,
    type_: Column,
    category: Column,
    subcategory: Column,
    languages: Column,
) -> Column:
    """Tagged fields with a gloss for the type, a reach marker and the task sentence."""
    gloss = F.lit(None).cast("string")
    for value, text in TYPE_GLOSS.items():
        gloss = F.when(type_ == value, F.lit(f"Type: {text}")).otherwise(gloss)
    parts = F.concat_ws(
        ". ",
        _tagged("Item", filled(name)),
        _tagged("Description", filled(description)),
        gloss,
        F.when(category != "", _tagged("Category", category)),
        F.when(subcategory != "", _tagged("Subcategory", subcategory)),
        reach_tag(languages),
    )
    return F.concat(parts, F.lit(". " + TASK_SUFFIX))


def enriched_description(description: Column, summary: Column, languages: Column) -> Column:
    """Description followed by the encyclopedia summary and a coverage sentence."""
    coverage = F.when(languages > 50, F.lit("Available in 50+ languages.")).when(
        languages > 20, F.concat(F.lit("Available in "), languages.cast("string"), F.lit(" languages."))
    )
    return F.concat_ws(
        " ",
        filled(description),
        F.when(summary != "", F.concat(F.lit("Wikipedia: "), summary)),
        coverage,
    )
