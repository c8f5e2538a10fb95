"""From tables of lifted code to class records: canonical instruction texts, the references in them, and projections of
instructions, methods and classes, as column expressions and joins.

A type is a struct (name, status): status is `platform`, `app` or `phantom` (unknown) for a plain class, null for what is no
plain class (int, arrays). An operand is a struct (local, text): a local's type, or a constant's text. A member is a
struct (owner, name, type, params, idx): a field has no params, idx is a method's place in its class. A value is a struct (kind,
text, op, index, type, base, args, member) of one of VALUE_KINDS; other kinds keep their text.

statements: (artifact, cls, method, block, pos, kind, left, right, keys), kinds as in normalise.unit_text, an
invocation's value on the left; methods: (artifact, cls, idx, name, params, concrete); edges: (artifact, cls, method, src, dst);
classes: (artifact, cls, status, superclass, interfaces), with the platform's classes and all superclasses among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.functions import hashing, normalise
from sigweave.sources.storage import materialise

TYPE = "struct<name:string,status:string>"
OPERAND = f"struct<local:{TYPE},text:string>"
MEMBER = f"struct<owner:{TYPE},name:string,type:{TYPE},params:array<{TYPE}>,idx:int>"
VALUE = f"struct<kind:string,text:string,op:string,index:int,type:{TYPE},base:{OPERAND},args:array<{OPERAND}>,member:{MEMBER}>"
STATEMENTS = f"artifact string, cls string, method int, block int, pos int, kind string, left {VALUE}, right {VALUE}, keys array<string>"
METHODS = f"artifact string, cls string, idx int, name string, params array<{TYPE}>, concrete boolean"

VALUE_KINDS = ("local", "constant", "binop", "field", "invoke", "this", "parameter", "caughtexception", "cast", "array", "new", "newarray", "neg", "lengthof", "instanceof")
# Kinds of invocation, and the hash of a method that only calls its superclass's constructor.
INVOKES = ("virtual", "special", "interface", "static", "dynamic")
DEFAULT_CONSTRUCTOR = 610540073


# ---------------------------------------------------------------- texts


def type_text(t: Column) -> Column:
    return normalise.type_name(t["name"], t["status"] == "platform", t["status"].isNotNull())


def type_refs(t: Column) -> Column:
    return normalise.recorded_reference(t["name"], F.coalesce(t["status"] == "platform", F.lit(False)), F.coalesce(t["status"] == "app", F.lit(False)), F.coalesce(t["status"] == "phantom", F.lit(False)))


def operand_text(o: Column) -> Column:
    return F.when(o["local"].isNotNull(), F.concat(F.lit("<"), type_text(o["local"]), F.lit(">"))).otherwise(o["text"])


def invoke_type(kind: Column) -> Column:
    """The keyword of a kind of invocation; `invoke` for unknown ones."""
    return F.when(kind.isin(*INVOKES), F.concat(kind, F.lit("invoke"))).otherwise(F.lit("invoke"))


def member_text(m: Column, masked: bool = True) -> Column:
    """<Owner: Type name> of a field, <Owner: Return name(P,P)> of a method; unmasked, all names as they are."""
    platform = m["owner"]["status"] == "platform" if masked else F.lit(True)
    text = type_text if masked else lambda t: t["name"]
    field = normalise.field_signature(text(m["owner"]), text(m["type"]), m["name"], platform)
    method = normalise.method_signature(text(m["owner"]), text(m["type"]), m["name"], F.transform(m["params"], text), platform)
    return F.when(m["params"].isNull(), field).otherwise(method)


def value_text(v: Column) -> Column:
    """The canonical text of a value: locals and application classes without their names."""
    arg = lambda i: operand_text(F.get(v["args"], F.lit(i)))
    based = F.coalesce(F.concat(operand_text(v["base"]), F.lit(".")), F.lit(""))
    kinds = {
        "local": arg(0),
        "binop": F.concat(arg(0), v["op"], arg(1)),
        "field": F.concat(based, member_text(v["member"])),
        "invoke": F.concat(invoke_type(v["op"]), F.lit(" "), based, member_text(v["member"]), F.lit("("), F.array_join(F.transform(v["args"], operand_text), ","), F.lit(")")),
        "this": F.lit("@this"),
        "parameter": F.concat(F.lit("@parameter"), v["index"].cast("string"), F.lit(": "), type_text(v["type"])),
        "caughtexception": F.lit("@caughtexception"),
        "cast": F.concat(F.lit("("), type_text(v["type"]), F.lit(") "), arg(0)),
        "array": F.concat(arg(0), F.lit("["), arg(1), F.lit("]")),
        "new": F.concat(F.lit("new "), type_text(v["type"])),
        "newarray": F.concat(F.lit("newarray ("), type_text(v["type"]), F.lit(")["), arg(0), F.lit("]")),
        "neg": F.concat(F.lit("neg "), arg(0)),
        "lengthof": F.concat(F.lit("lengthof "), arg(0)),
        "instanceof": F.concat(arg(0), F.lit(" instanceof "), type_text(v["type"])),
    }
    out = v["text"]
    for kind, text in reversed(kinds.items()):
        out = F.when(v["kind"] == kind, text).otherwise(out)
    return out


# ---------------------------------------------------------------- references


def _all(*lists: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(x, none) for x in lists])


def member_refs(m: Column) -> Column:
    return _all(type_refs(m["owner"]), type_refs(m["type"]), F.flatten(F.transform(m["params"], type_refs)))


def value_refs(v: Column) -> Column:
    """The application's classes (null for unknown ones) that a value's text leaves out, in order of the text."""
    local = lambda o: type_refs(o["local"])
    args = F.flatten(F.transform(v["args"], local))
    return (
        F.when(v["kind"].isin("field", "invoke"), _all(local(v["base"]), member_refs(v["member"]), args))
        .when(v["kind"].isin("instanceof"), _all(args, type_refs(v["type"])))
        .when(v["kind"].isin(*(k for k in VALUE_KINDS if k not in ("constant", "this", "caughtexception"))), _all(type_refs(v["type"]), args))
        .otherwise(F.array().cast("array<string>"))
    )


# ---------------------------------------------------------------- instructions, methods, classes


def instructions(statements: DataFrame) -> DataFrame:
    """(artifact, cls, method, block, pos, instr, ref_types, has_inv, ref_cls, ref_idx, platform_ref): one row per statement; platform_ref is the platform's method or field that it uses, by full name."""
    left, right = F.col("left"), F.col("right")
    instr = normalise.unit_text(F.col("kind"), value_text(left), value_text(right), F.col("keys"))
    refs = F.when(F.col("kind").isin("goto", "nop"), F.array().cast("array<string>")).when(F.col("kind") == "identity", value_refs(right)).otherwise(_all(value_refs(left), value_refs(right)))
    uses = lambda kind: F.coalesce(F.when(left["kind"] == kind, left["member"]), F.when(right["kind"] == kind, right["member"]))
    callee, field = uses("invoke"), uses("field")
    status = callee["owner"]["status"]
    return statements.select(
        "artifact", "cls", "method", "block", "pos", instr.alias("instr"), refs.alias("ref_types"),
        (callee.isNotNull() & ~F.coalesce(status == "platform", F.lit(False))).alias("has_inv"),
        F.when(status == "app", callee["owner"]["name"]).alias("ref_cls"), F.when(status == "app", callee["idx"]).alias("ref_idx"),
        F.when(callee.isNotNull(), F.when(status == "platform", member_text(callee, masked=False))).otherwise(F.when(field["owner"]["status"] == "platform", member_text(field, masked=False))).alias("platform_ref"),
    )


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNull(), "null").otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def method_records(methods: DataFrame, statements: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact, cls, idx, name, fix_types, refs, weight, hash, record): methods with their normalised parameters, the platform's members that they use, their number of
    instructions, their 32-bit hash (of name, instructions and edges) and their record as JSON. Methods without a body have weight 0."""
    key = ["artifact", "cls", "method"]
    units = instructions(statements)
    unit = F.concat_ws(",", _quoted(F.col("instr")), F.to_json("ref_types"), F.col("has_inv").cast("string"), _quoted(F.col("ref_cls")), F.coalesce(F.col("ref_idx").cast("string"), F.lit("null")))
    rows = units.withColumn("unit", F.concat(F.lit("["), unit, F.lit("]"))).withColumn("h", hashing.text_hash(F.col("instr")))
    ordered = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    blocks = rows.groupBy(*key, "block").agg(ordered("pos", "unit", "h").alias("u"), ordered("pos", "platform_ref").alias("r"))  # as many as the block has instructions
    blocks = blocks.select(*key, "block", F.concat(F.lit("["), F.array_join("u.unit", ","), F.lit("]")).alias("units"), F.size("u").alias("n"), hashing.sequence_hash(F.col("u.h")).alias("h"), F.col("r.platform_ref").alias("refs"))
    bodies = blocks.groupBy(*key).agg(ordered("block", "units", "h", "refs").alias("b"), F.sum("n").alias("weight"))
    bodies = bodies.select(*key, "weight", F.concat(F.lit("["), F.array_join("b.units", ","), F.lit("]")).alias("blocks"), hashing.sequence_hash(F.col("b.h")).alias("bh"), F.filter(F.flatten("b.refs"), lambda r: r.isNotNull()).alias("refs"))
    follows = edges.select("artifact", "cls", "method", "src", "dst").distinct().groupBy(*key, "src").agg(F.sort_array(F.collect_list("dst")).alias("to"), F.sum("dst").alias("sum"))
    follows = follows.groupBy(*key).agg(
        F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("src").cast("string"), "to"))))).alias("succs"), F.sum(F.col("src").bitwiseXOR(F.col("sum"))).alias("sh")
    )
    all_ = methods.withColumnRenamed("idx", "method").join(bodies, key, "left").join(follows, key, "left")
    fix = F.transform("params", type_text)
    refs = F.coalesce("refs", F.array().cast("array<string>"))
    hash_ = hashing.text_hash(F.col("name")).bitwiseXOR(F.coalesce("bh", F.lit(1))).bitwiseXOR(F.pmod(F.coalesce("sh", F.lit(0)), F.lit(hashing.MODULUS)))
    record = F.concat(
        F.lit('{"name":'), _quoted(F.col("name")), F.lit(',"fixTypes":'), F.to_json(fix), F.lit(',"blocks":'), F.coalesce("blocks", F.lit("[]")), F.lit(',"blockSuccs":'), F.coalesce("succs", F.lit("{}")),
        F.lit(',"refs":'), F.to_json(refs), F.lit(',"idx":'), F.col("method").cast("string"), F.lit("}"),
    )
    return all_.select("artifact", "cls", F.col("method").alias("idx"), "name", fix.alias("fix_types"), refs.alias("refs"), F.coalesce("weight", F.lit(0)).alias("weight"), hash_.alias("hash"), record.alias("record"))


def platform_superclass(classes: DataFrame) -> DataFrame:
    """(artifact, cls, lib_super): the nearest superclass that is the platform's; null if the walk up ends at none. Each step doubles the walk."""
    up = materialise(classes.select("artifact", "cls", F.col("superclass").alias("at")))
    status = classes.select("artifact", F.col("cls").alias("at"), "status")
    # a class stands for itself if it is the platform's or has nothing above, else for what its superclass stands for
    stands = up.join(status, ["artifact", "at"], "left").select("artifact", "cls", F.when(F.col("status") == "platform", F.col("at")).alias("found"), F.when(F.coalesce(F.col("status") != "platform", F.lit(True)), F.col("at")).alias("at"))
    while True:
        stands = materialise(stands)
        if stands.where("found IS NULL AND at IS NOT NULL").isEmpty():
            return stands.select("artifact", "cls", F.col("found").alias("lib_super"))
        beyond = stands.select("artifact", F.col("cls").alias("at"), F.col("found").alias("f"), F.col("at").alias("a"))
        joined = stands.join(beyond, ["artifact", "at"], "left")
        stands = joined.select("artifact", "cls", F.coalesce("found", "f").alias("found"), F.when(F.coalesce("found", "f").isNull(), F.col("a")).alias("at"))


def class_records(classes: DataFrame, methods: DataFrame, statements: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact, cls, lib_super, app_super, interfaces, weight, record) of the application's classes: without default constructors, with the nearest superclass that is the
    platform's, the direct one that is the application's, and the application's interfaces; record is what sources.signatures reads."""
    key = ["artifact", "cls"]
    own = method_records(methods, statements, edges)
    kept = own.where(~(normalise.is_constructor(F.col("name")) & (F.col("hash") == DEFAULT_CONSTRUCTOR)))
    bodies = kept.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("idx", "record"))).alias("m"), F.sum("weight").alias("weight"))  # as many as the class has methods
    status = lambda name: classes.where("status = 'app'").select("artifact", F.col("cls").alias(name))
    app = classes.where("status = 'app'")
    supers = app.select(*key, F.col("superclass").alias("app_super")).join(status("app_super"), ["artifact", "app_super"], "left_semi")
    faces = app.select(*key, F.explode("interfaces").alias("face")).join(status("face"), ["artifact", "face"], "left_semi").groupBy(*key).agg(F.sort_array(F.collect_set("face")).alias("faces"))
    rows = app.select(*key).join(platform_superclass(classes), key, "left").join(supers, key, "left").join(faces, key, "left").join(bodies, key, "left")
    interfaces = F.coalesce("faces", F.array().cast("array<string>"))
    maybe = lambda name, c: F.coalesce(F.concat(F.lit(f',"{name}":'), F.when(F.col(c).isNotNull(), _quoted(F.col(c)))), F.lit(""))
    record = F.concat(F.lit('{"name":'), _quoted(F.col("cls")), F.lit(',"methods":['), F.coalesce(F.array_join("m.record", ","), F.lit("")), F.lit("]"), maybe("super", "lib_super"), maybe("superType", "app_super"), F.lit(',"interfaces":'), F.to_json(interfaces), F.lit("}"))
    return rows.select(*key, "lib_super", "app_super", interfaces.alias("interfaces"), F.coalesce("weight", F.lit(0)).alias("weight"), record.alias("record"))
