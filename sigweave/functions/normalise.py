"""Normalising projections over instruction records and raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "#"


def type_name(name: Column, is_platform: Column, is_class: Column | None = None) -> Column:
    """Platform types keep their name, other class types become the mask; what isn't a plain class type keeps its text."""
    masked = F.when(is_platform, name).otherwise(F.lit(MASK))
    return masked if is_class is None else F.when(is_class, masked).otherwise(name)


def recorded_reference(name: Column, is_platform: Column, is_app: Column, is_phantom: Column) -> Column:
    """The references that a type gives: its name for application classes, null for unknown ones, none for others."""
    none = F.array().cast("array<string>")
    return F.when(is_platform, none).when(is_app, F.array(name)).when(is_phantom, F.array(F.lit(None).cast("string"))).otherwise(none)


def field_signature(owner: Column, kind: Column, member: Column, is_platform: Column) -> Column:
    """<Owner: Type member>, the member masked unless it is the platform's."""
    return F.concat(F.lit("<"), owner, F.lit(": "), kind, F.lit(" "), F.when(is_platform, member).otherwise(F.lit(MASK)), F.lit(">"))


def method_signature(owner: Column, returns: Column, member: Column, parameters: Column, is_platform: Column) -> Column:
    """<Owner: Type member(P,P)>, the member masked unless it is the platform's."""
    name = F.when(is_platform, member).otherwise(F.lit(MASK))
    return F.concat(F.lit("<"), owner, F.lit(": "), returns, F.lit(" "), name, F.lit("("), F.array_join(parameters, ","), F.lit(")>"))


def unit_text(kind: Column, left: Column, right: Column, keys: Column) -> Column:
    """The canonical text of an instruction of a kind with its normalised operands."""
    switch = F.concat(F.lit("("), left, F.lit(") {"))
    return (
        F.when(kind == "assign", F.concat(left, F.lit(" = "), right))
        .when(kind == "identity", F.concat(F.lit("identity "), right))
        .when(kind == "goto", F.lit("goto"))
        .when(kind == "if", F.concat(F.lit("if "), left))
        .when(kind == "invoke", left)
        .when(kind == "return", F.coalesce(left, F.lit("return")))
        .when(kind == "tableswitch", F.concat(F.lit("tableswitch "), switch, F.element_at(keys, 1), F.lit(" - "), F.element_at(keys, -1), F.lit("}")))
        .when(kind == "lookupswitch", F.concat(F.lit("lookupswitch "), switch, F.array_join(keys, ", "), F.lit("}")))
        .when(kind.isin("throw", "entermonitor", "exitmonitor"), F.concat(kind, F.lit(" "), left))
        .when(kind == "nop", F.lit("nop"))
        .otherwise(F.concat_ws(" ", kind, left, right))
    )


def is_constructor(name: Column) -> Column:
    return name.isin("<init>", "<clinit>")


def full_name(name: Column, parameters: Column) -> Column:
    return F.concat(name, F.lit("("), F.array_join(parameters, ", "), F.lit(")"))


def percent(share: Column) -> Column:
    """A share as a percentage with five decimals; shares outside 0..1 are an error."""
    bad = (share < 0) | (share > 1)
    return F.when(bad, F.raise_error(F.lit("not a share between 0 and 1"))).otherwise(F.format_string("%.5f%%", share * 100))


def mask_identifiers(text: Column) -> Column:
    """E-mail addresses and digit runs become the mask."""
    return F.regexp_replace(F.regexp_replace(text, r"[A-Za-z0-9._+]+@[A-Za-z0-9.]+", MASK), r"[0-9]+", MASK)
