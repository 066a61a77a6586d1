"""Receipts, captures and the two-person rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.functions import text as T
from spanledger.operators.support import computed

# Fixed values. Grammars of receipt fields.
HOST = r"^[a-z0-9][a-z0-9.-]{1,62}$"
CAPTURE_PATH = r"^tests/captures/(7|8|9|10)/[a-z0-9-]+\.json$"
SHA256 = r"^[0-9a-f]{64}$"
ZONED_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def _roles(roster: DataFrame, role: str, name: str) -> DataFrame:
    return roster.where(F.array_contains("roles", role)).select(
        T.normal_name(F.col("name")).alias(name), F.lit(True).alias(f"{name}_ok")).distinct()


def receipt_audit(receipts: DataFrame, captures: DataFrame, current: DataFrame,
                  roster: DataFrame) -> DataFrame:
    """(entry_id, release, code) for each rule a receipt breaks.

    receipts: entry_id, release, signed_by, host; captures: entry_id, release, host,
    captured_by, command_as_run, command_hash; current: entry_id, release, command.
    """
    key = ["entry_id", "release"]
    caps = captures.select(*key, F.col("host").alias("_chost"), "captured_by", "command_as_run",
                           "command_hash", F.lit(True).alias("_cap"))
    now = current.select(*key, F.col("command").alias("_now"))
    d = (receipts.join(caps, key, "left").join(now, key, "left")
         .withColumns({"_by": T.normal_name(F.coalesce("signed_by", F.lit(""))),
                       "_capby": T.normal_name(F.coalesce("captured_by", F.lit("")))})
         .join(_roles(roster, "QA", "_by"), "_by", "left")
         .join(_roles(roster, "SME", "_capby"), "_capby", "left"))
    have = F.coalesce("_cap", F.lit(False))
    codes = F.array_compact(F.array(
        F.when(F.coalesce("signed_by", F.lit("")) == "", "signer-missing"),
        F.when(~F.col("host").rlike(HOST), "host-grammar"),
        F.when(~have, "no-capture"),
        F.when(have & (F.sha2("command_as_run", 256) != F.col("command_hash")), "hash-mismatch"),
        F.when(have & (F.col("host") != F.col("_chost")), "host-differs"),
        F.when(have & (F.col("command_as_run") != F.col("_now")), "command-changed"),
        F.when((F.col("_by") != "") & F.col("_by_ok").isNull(), "signer-not-qa"),
        F.when(have & F.col("_capby_ok").isNull(), "capturer-not-sme"),
        F.when(have & (F.col("_by") != "") & (F.col("_by") == F.col("_capby")), "one-person")))
    return d.select(*key, F.explode(codes).alias("code"))


def execution_receipt_violations(receipts: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, code) for each rule an execution receipt breaks."""
    digests = ["command_sha256", "artifact_sha256", "content_fingerprint", "stdout_sha256", "stderr_sha256"]
    texts = ["tool_version", "entry_id", "target", "operator", "ticket", "verification"]
    rules = [F.when(F.trim(F.coalesce(c, F.lit(""))) == "", f"empty-{c}") for c in texts]
    rules += [F.when(~F.coalesce(F.col(c).rlike(SHA256), F.lit(False)), f"digest-form-{c}") for c in digests]
    rules += [F.when(~F.coalesce(F.sha2(c, 256) == F.col(f"{c}_sha256"), F.lit(False)), f"digest-{c}")
              for c in ("command", "stdout", "stderr")]
    zoned = F.coalesce(F.col("executed_at").rlike(ZONED_TIMESTAMP)
                       & F.try_to_timestamp("executed_at").isNotNull(), F.lit(False))
    rules += [
        F.when(~F.coalesce(F.col("rhel_version").isin("7", "8", "9", "10"), F.lit(False)), "release"),
        F.when(~zoned, "timestamp-zone"),
        F.when(F.col("exit_code").isNull(), "exit-code"),
        F.when(~F.coalesce("attestation.command_was_executed", F.lit(False)), "not-executed"),
        F.when(~F.coalesce("attestation.outputs_are_actual", F.lit(False)), "outputs-not-actual"),
        F.when(F.trim(F.coalesce("attestation.statement", F.lit(""))) == "", "no-statement")]
    return receipts.select(key, F.explode(F.array_compact(F.array(*rules))).alias("code"))


# The properties of an execution receipt, a closed set, and those of its attestation.
RECEIPT_FIELDS = ("schema tool_version entry_id rhel_version target operator executed_at ticket command command_sha256 artifact_sha256 "
                  "content_fingerprint exit_code stdout stdout_sha256 stderr stderr_sha256 verification attestation").split()
ATTESTATION_FIELDS = "command_was_executed outputs_are_actual statement".split()
RECEIPT = (", ".join(f"{f} string" for f in RECEIPT_FIELDS if f not in ("exit_code", "attestation"))
           + ", exit_code int, attestation struct<command_was_executed:boolean,outputs_are_actual:boolean,statement:string>")


def receipt_text_violations(receipts: DataFrame, key: str, body: str, schema: str) -> DataFrame:
    """(key, code) for each rule that a receipt, one JSON text a row, breaks.

    A text that is no object is ``not-an-object``. Properties outside the closed set are told as they are; while any
    property is missing, only missing and undeclared ones are. Then come the schema's name and the rules of
    ``execution_receipt_violations``, and undeclared properties of the attestation.
    """
    own = F.json_object_keys(body)
    named = lambda names: F.array(*map(F.lit, names))
    d = computed(receipts.select(F.col(key).cast("string").alias("_key"), body), {"_own": own})
    undeclared = F.transform(F.array_except("_own", named(RECEIPT_FIELDS)), lambda k: F.concat(F.lit("undeclared-"), k))
    missing = F.transform(F.array_except(named(RECEIPT_FIELDS), F.col("_own")), lambda k: F.concat(F.lit("missing-"), k))
    codes = F.when(F.col("_own").isNull(), F.array(F.lit("not-an-object"))).otherwise(F.concat(undeclared, missing))
    d = computed(d, {"_codes": codes, "_whole": F.col("_own").isNotNull() & (F.size(missing) == 0), "r": F.from_json(body, RECEIPT)})
    inner = F.json_object_keys(F.get_json_object(body, "$.attestation"))
    more = F.concat(F.array_compact(F.array(F.when(~F.coalesce(F.col("r.schema") == schema, F.lit(False)), "schema"))),
                    F.transform(F.array_except(F.coalesce(inner, F.array().cast("array<string>")), named(ATTESTATION_FIELDS)),
                                lambda k: F.concat(F.lit("undeclared-attestation-"), k)))
    first = d.select("_key", F.explode(F.when(F.col("_whole"), F.concat("_codes", more)).otherwise(F.col("_codes"))).alias("code"))
    rest = execution_receipt_violations(d.where("_whole").select(F.col("_key"), "r.*").withColumn("_id", F.col("_key")), "_id")
    return first.unionByName(rest.withColumnRenamed("_id", "_key")).withColumnRenamed("_key", key)


def attestation_needed(entries: DataFrame, roster: DataFrame) -> DataFrame:
    """Restricted rows whose source cannot be checked here and that lack a QA attestation.

    entries: entry_id, license_class, source_ref, attested_by, attested_on.
    """
    checkable = F.coalesce(F.col("source_ref").rlike("^(man |content-src/raw/)"), F.lit(False))
    d = (entries.where((F.col("license_class") == "paraphrase-only") & ~checkable)
         .withColumn("_who", T.normal_name(F.coalesce("attested_by", F.lit(""))))
         .join(_roles(roster, "QA", "_who"), "_who", "left"))
    code = (F.when((F.coalesce("attested_by", F.lit("")) == "") | (F.coalesce("attested_on", F.lit("")) == ""),
                   "no-attestation").when(F.col("_who_ok").isNull(), "not-qa"))
    return d.withColumn("code", code).where(F.col("code").isNotNull()).select("entry_id", "code")


def verification_status(slots: DataFrame, receipts: DataFrame, captures: DataFrame) -> DataFrame:
    """verified, captured or not verified per slot; a pointer slot never inherits a status."""
    key = ["entry_id", "release"]
    r = receipts.select(*key, F.lit(True).alias("_r")).distinct()
    c = captures.select(*key, F.lit(True).alias("_c")).distinct()
    own = ~F.col("is_pointer")
    return slots.join(r, key, "left").join(c, key, "left").select(
        *key, F.when(own & F.col("_r").isNotNull(), "verified").when(own & F.col("_c").isNotNull(), "captured")
        .otherwise("not verified").alias("status"))
