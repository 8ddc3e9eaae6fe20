"""Model inventories as tables: manifest lookup, operator and domain allowlists, input budgets, gate findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Operators that a model may use.
ALLOWED_OPERATORS = tuple(
    """
    Abs Acos Acosh Add And ArgMax ArgMin Asin Asinh Atan Atanh AveragePool BatchNormalization BitShift Cast CastLike Ceil Celu Clip
    Compress Concat ConcatFromSequence Constant ConstantOfShape Conv ConvInteger ConvTranspose Cos Cosh CumSum DepthToSpace
    DequantizeLinear Div Dropout Einsum Elu Equal Erf Exp Expand EyeLike Flatten Floor GRU Gather GatherElements GatherND Gelu Gemm
    GlobalAveragePool GlobalLpPool GlobalMaxPool Greater GreaterOrEqual GridSample HardSigmoid HardSwish Hardmax Identity
    InstanceNormalization IsInf IsNaN LRN LSTM LayerNormalization LeakyRelu Less LessOrEqual Log LogSoftmax LpNormalization LpPool
    MatMul MatMulInteger Max MaxPool MaxRoiPool MaxUnpool Mean MeanVarianceNormalization Min Mod Mul Multinomial Neg
    NonMaxSuppression NonZero Not OneHot Or PRelu Pad Pow QLinearConv QLinearMatMul QuantizeLinear RNN Range Reciprocal ReduceL1
    ReduceL2 ReduceLogSum ReduceLogSumExp ReduceMax ReduceMean ReduceMin ReduceProd ReduceSum ReduceSumSquare Relu Reshape Resize
    ReverseSequence RoiAlign Round Scan Scatter ScatterElements ScatterND Selu SequenceAt SequenceConstruct SequenceEmpty
    SequenceErase SequenceInsert SequenceLength Shape Shrink Sigmoid Sign Sin Sinh Size Slice Softmax SoftmaxCrossEntropyLoss Softplus
    Softsign SpaceToDepth Split SplitToSequence Sqrt Squeeze StringNormalizer Sub Sum Tan Tanh TfIdfVectorizer ThresholdedRelu Tile
    TopK Transpose Trilu Unique Unsqueeze Upsample Where Xor
    """.split()
)
#: Domains that a model may use.
ALLOWED_DOMAINS = ("", "ai.onnx", "ai.onnx.ml")

MOST_ELEMENTS, MOST_PER_DIM, MOST_NODES = 16_000_000, 65_536, 50_000


def verify_manifest(models: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """(model_id, sha256, status, approved_id) of models (model_id, sha256).

    The first approved entry of an equal hash, in any case, wins. ``manifest`` is (position, model_id,
    sha256); None where it is missing.
    """
    if manifest is None:
        return models.select("model_id", "sha256", F.lit("MANIFEST_NOT_FOUND").alias("status"), F.lit(None).cast("string").alias("approved_id"))
    first = manifest.groupBy(F.lower("sha256").alias("key")).agg(F.min_by(F.col("model_id").cast("string"), "position").alias("approved_id"))
    joined = models.withColumn("key", F.lower("sha256")).join(first, "key", "left")
    known = F.col("approved_id").isNotNull()
    return joined.select("model_id", "sha256", F.when(known, F.concat(F.lit("MANIFEST_VERIFIED_OK (Approved ID: "), "approved_id", F.lit(")"))).otherwise("MANIFEST_MISMATCH_UNAPPROVED_MODEL").alias("status"), "approved_id")


def disallowed_operators(nodes: DataFrame, allowed: tuple[str, ...] = ALLOWED_OPERATORS) -> DataFrame:
    """Nodes whose operator is not allowed, a row each. The list is a parameter, so the check is a predicate on the scan."""
    return nodes.where(~F.coalesce(F.col("op_type").isin(*allowed), F.lit(False)))


def disallowed_domains(nodes: DataFrame, allowed: tuple[str, ...] = ALLOWED_DOMAINS) -> DataFrame:
    """Nodes of other domains, with ``offence`` as domain::operator."""
    return nodes.where(~F.coalesce(F.col("domain"), F.lit("")).isin(*allowed)).withColumn("offence", F.concat_ws("::", "domain", "op_type"))


def feed_inputs(inputs: DataFrame, initializers: DataFrame) -> DataFrame:
    """Inputs that no initializer fills."""
    return inputs.join(initializers.select("model_id", F.col("name").alias("input_name")), ["model_id", "input_name"], "left_anti")


def operator_inventory(nodes: DataFrame, allowed: tuple[str, ...] = ALLOWED_OPERATORS, most_nodes: int = MOST_NODES) -> DataFrame:
    """Per model: node count, sorted distinct operators, sorted distinct disallowed ones, and whether it is within the limit."""
    bad = F.when(~F.coalesce(F.col("op_type").isin(*allowed), F.lit(False)), F.col("op_type"))
    return nodes.groupBy("model_id").agg(F.count("*").alias("n_nodes"), F.array_sort(F.collect_set("op_type")).alias("operators"), F.array_sort(F.collect_set(bad)).alias("disallowed")).withColumn("within_limit", F.col("n_nodes") <= most_nodes)


def input_elements(inputs: DataFrame) -> DataFrame:
    """(model_id, input_name, elements, largest_dim): products of the positive dims; an unknown dim counts as 1, zero is passed over.

    The product is an exact decimal, and null (over any limit) where even that overflows.
    """
    dim = F.when(F.col("dim_value").isNull(), F.lit(1).cast("bigint")).when(F.col("dim_value") > 0, F.col("dim_value"))
    dims = inputs.select("model_id", "input_name", dim.alias("d"), F.col("dim_value"))
    product = F.aggregate(F.collect_list("d"), F.lit(1).cast("decimal(38,0)"), lambda a, d: F.try_multiply(a, d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    return dims.groupBy("model_id", "input_name").agg(product.alias("elements"), F.max("dim_value").alias("largest_dim"), F.count_if(F.col("dim_value") > 0).alias("known_dims"))


def input_budget(inputs: DataFrame, most: int = MOST_ELEMENTS, per_dim: int = MOST_PER_DIM) -> DataFrame:
    """Per model: total elements of its inputs, the largest, the largest dim, and whether all limits hold."""
    each = input_elements(inputs)
    row = each.groupBy("model_id").agg(F.sum("elements").alias("total_elements"), F.max("elements").alias("largest_input"), F.max("largest_dim").alias("largest_dim"), F.count_if(F.col("elements").isNull()).alias("overflows"))
    ok = (F.col("overflows") == 0) & (F.col("total_elements") <= most) & (F.coalesce("largest_dim", F.lit(0)) <= per_dim)
    return row.withColumn("within_budget", F.coalesce(ok, F.lit(False))).drop("overflows")


def firewall_report(models: DataFrame, nodes: DataFrame, inputs: DataFrame, initializers: DataFrame) -> DataFrame:
    """(model_id, violations, passed): every violation of operators, domains, node count and inputs, sorted."""
    op = disallowed_operators(nodes).select("model_id", F.concat(F.lit("DISALLOWED_OPERATOR: "), "op_type").alias("violation"))
    domain = disallowed_domains(nodes).select("model_id", F.concat(F.lit("DISALLOWED_DOMAIN: "), "offence").alias("violation"))
    count = nodes.groupBy("model_id").count().where(F.col("count") > MOST_NODES).select("model_id", F.concat(F.lit("NODE_LIMIT: "), F.col("count").cast("string")).alias("violation"))
    fed = feed_inputs(inputs, initializers)
    each = input_elements(fed).where(F.coalesce(F.col("elements") > MOST_ELEMENTS, F.lit(True))).select("model_id", F.concat(F.lit("INPUT_ELEMENTS: "), "input_name").alias("violation"))
    dims = fed.where(F.col("dim_value") > MOST_PER_DIM).select("model_id", F.concat(F.lit("INPUT_DIMENSION: "), "input_name").alias("violation"))
    whole = input_budget(fed).where(F.coalesce(F.col("total_elements") > MOST_ELEMENTS, F.lit(True))).select("model_id", F.lit("TOTAL_INPUT_ELEMENTS").alias("violation"))
    found = op.unionByName(domain).unionByName(count).unionByName(each).unionByName(dims).unionByName(whole)
    listed = found.groupBy("model_id").agg(F.array_sort(F.collect_list("violation")).alias("violations"))
    rows = models.select("model_id").join(listed, "model_id", "left").withColumn("violations", F.coalesce("violations", F.array().cast("array<string>")))
    return rows.withColumn("passed", F.size("violations") == 0)


def graph_io_check(models: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per model: counts and shapes of inputs and outputs, and NO_INPUTS, NO_OUTPUTS or OK."""

    def side(table: DataFrame, name: str) -> DataFrame:
        dim = F.coalesce(F.col("dim_value").cast("string"), "dim_param", F.lit("?"))
        shapes = table.groupBy("model_id", f"{name}_name").agg(F.array_sort(F.collect_list(F.struct("dim_pos", dim.alias("d")))).alias("ds"))
        shape = F.concat(F.col(f"{name}_name"), F.lit("["), F.array_join(F.transform("ds", lambda x: x["d"]), ","), F.lit("]"))
        return shapes.groupBy("model_id").agg(F.count("*").alias(f"n_{name}s"), F.array_sort(F.collect_list(shape)).alias(f"{name}s"))

    joined = models.select("model_id").join(side(inputs, "input"), "model_id", "left").join(side(outputs, "output"), "model_id", "left")
    joined = joined.withColumns({f"n_{s}s": F.coalesce(f"n_{s}s", F.lit(0)) for s in ("input", "output")})
    return joined.withColumn("status", F.when(F.col("n_inputs") == 0, "NO_INPUTS").when(F.col("n_outputs") == 0, "NO_OUTPUTS").otherwise("OK"))


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Per model with scanner issues: their count, list, and one finding."""
    return issues.groupBy("model_id").agg(F.count("*").alias("n_issues"), F.array_sort(F.collect_list(F.concat_ws(": ", "severity", "description"))).alias("issues")).withColumn("finding_type", F.lit("UNSAFE_SERIALIZATION_INDICATOR"))


def artifact_precheck(files: DataFrame, extensions: tuple[str, ...] = (".onnx",)) -> DataFrame:
    """(path, status) of expected files (path, length null where missing), checks in order."""
    from plumbline.functions.exprs import has_extension

    return files.select("path", F.when(F.col("length").isNull(), "FILE_NOT_FOUND").when(~has_extension(F.col("path"), extensions, True), "INVALID_FILE_EXTENSION").when(F.col("length") == 0, "EMPTY_FILE").otherwise("OK").alias("status"))


def safety_gate(models: DataFrame, manifest: DataFrame | None, nodes: DataFrame, inputs: DataFrame, initializers: DataFrame, issues: DataFrame) -> DataFrame:
    """Findings (subject_id, pos, finding_type, title, risk_score, evidence_strength, is_hard_gate) of each model (model_id, sha256, format_ok)."""

    def finding(rows: DataFrame, pos: int, kind: str, title: str, risk: float) -> DataFrame:
        return rows.select(F.col("model_id").alias("subject_id"), F.lit(pos).alias("pos"), F.lit(kind).alias("finding_type"), F.lit(title).alias("title"), F.lit(risk).alias("risk_score"), F.lit("HIGH").alias("evidence_strength"), F.lit(True).alias("is_hard_gate"))

    wall = finding(firewall_report(models, nodes, inputs, initializers).where(~F.col("passed")), 0, "ONNX_GRAPH_FIREWALL", "ONNX Graph Firewall Violation", 100.0)
    shape = finding(models.where(~F.col("format_ok")), 1, "INVALID_FILE_FORMAT", "Invalid Artifact Format", 100.0)
    listed = finding(verify_manifest(models, manifest).where(~F.col("status").startswith("MANIFEST_VERIFIED_OK")), 2, "MANIFEST_MISMATCH", "Unapproved Model Hash / Manifest Mismatch", 95.0)
    scanned = finding(issue_rollup(issues).join(models.where("format_ok").select("model_id"), "model_id"), 3, "UNSAFE_SERIALIZATION_INDICATOR", "ModelScan Unsafe Serialization Detection", 100.0)
    return wall.unionByName(shape).unionByName(listed).unionByName(scanned)


def first_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")
