"""Schemas of the tools that models are offered, made from short tables of their names and parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .tags import CATEGORIES

BOTH = ("name_zh", "name_en", "description_zh", "description_en")
#: Tool -> (what it does, parameters, how many of these are required); fixed values but for the first.
GRAPH = {
    "add_symptom_node": ("Adds a symptom with its names and description in Chinese and English.", BOTH, 4),
    "add_syndrome_node": ("Adds a syndrome with names, description and herbal treatments in both languages.", (*BOTH, "herbal_zh", "herbal_en"), 6),
    "link_syndrome_symptom": ("Links a syndrome and a symptom, both by name.", ("syndrome_name", "symptom_name"), 2),
    "split_symptom_node": ("Splits a symptom into finer ones, which get all its links.", ("original_name", "children"), 2),
    "edit_symptom_node": ("Changes names or description of a symptom.", ("target_name", "new_name_zh", "new_name_en", "description_zh", "description_en"), 1),
    "edit_syndrome_node": ("Changes names, description or herbal treatments of a syndrome.", ("target_name", "new_name_zh", "new_name_en", "description_zh", "description_en", "herbal_zh", "herbal_en"), 1),
    "expand_symptom": ("Has the description of a symptom written out.", ("target_name", "notes"), 1),
    "expand_syndrome": ("Has description and herbal treatments of a syndrome written out.", ("target_name", "notes"), 1),
}
DIALOG = {
    "ask_patient": ("Asks the patient something, about some symptoms if need be.", ("question", "symptom_ids"), 1),
    "expand_symptom": ("Gives all that is known of a symptom.", ("symptom_id",), 1),
    "search_syndromes": ("Gives the syndromes that fit the symptoms best.", ("symptom_ids",), 1),
    "give_diagnosis": ("Ends the conversation with a syndrome.", ("syndrome_id", "notes"), 1),
}


def parameter(name: str) -> dict:
    if name == "children":
        return {"type": "array", "items": parameters(BOTH, 4)}
    return {"type": "array", "items": {"type": "string"}} if name.endswith("_ids") else {"type": "string"}


def parameters(names: Sequence[str], required: int) -> dict:
    return {"type": "object", "properties": {n: parameter(n) for n in names}, "required": list(names[:required])}


def tools(table: Mapping[str, tuple[str, Sequence[str], int]]) -> list[dict]:
    return [{"type": "function", "function": {"name": n, "description": text, "parameters": parameters(p, k)}} for n, (text, p, k) in table.items()]


def graph_tools() -> list[dict]:
    return tools(GRAPH)


def dialog_tools() -> list[dict]:
    return tools(DIALOG)


def tagging_tools() -> list[dict]:
    """One tool, tag_section, with a list of bilingual names for each category."""
    names = {"type": "array", "items": parameters(("name_zh", "name_en"), 2)}
    lists = {f"{c}_tags": names | {"description": f"Names of kind {c} in the section"} for c in CATEGORIES}
    return [{"type": "function", "function": {"name": "tag_section", "description": "Tags a section by category.", "parameters": {"type": "object", "properties": lists, "required": list(lists)}}}]


def spark_type(schema: Mapping) -> StringType | ArrayType | StructType:
    """The type of a schema's value, to read a call's arguments by from_json."""
    if schema["type"] == "array":
        return ArrayType(spark_type(schema["items"]))
    if schema["type"] == "object":
        return StructType([StructField(k, spark_type(v)) for k, v in schema["properties"].items()])
    return StringType()


def arguments_type(tool: str, offered: Sequence[Mapping]) -> StructType:
    """The type of a tool's arguments."""
    return next(spark_type(t["function"]["parameters"]) for t in offered if t["function"]["name"] == tool)
