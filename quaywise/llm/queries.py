"""The corpus operators' queries over whole tables, and the SQL that states those that SQL can state."""

from __future__ import annotations

from . import bytespans, centroids, langid, media, mixing, packing, phrases, pii, quality, secrets, sharding, simhash, substring
from .common import read_documents


def _over_documents(operator):
    return lambda spark, sf_dir: operator(read_documents(spark, sf_dir))


def _op2(spark, sf_dir):
    return mixing.op2_soft_mix(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_quality_ledger": _over_documents(quality.op1_quality_ledger),
    "quality_ablations": _over_documents(quality.quality_ablations),
    "op2_soft_mix": _op2,
    "op3_secrets": _over_documents(secrets.op3_secrets),
    "op4_pseudonyms": _over_documents(pii.op4_pseudonyms),
    "op5_packing": _over_documents(packing.op5_packing),
    "op6_language": _over_documents(langid.op6_language),
    "op7_substring_dedup": _over_documents(substring.op7_substring_dedup),
    "op8_media": _over_documents(media.op8_media),
    "op9_byte_shards": _over_documents(sharding.op9_byte_shards),
    "op10_simhash": _over_documents(simhash.op10_simhash),
    "op11_byte_spans": _over_documents(bytespans.op11_byte_spans),
    "op12_collocations": _over_documents(phrases.op12_collocations),
    "op13_annulus": lambda spark, sf_dir: centroids.op13_annulus(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
}

ORACLE_SQL = {
    "op1_quality_ledger": quality.ORACLE_SQL,
    "quality_ablations": quality.ABLATION_SQL,
    "op7_substring_dedup": substring.ORACLE_SQL,
    "op9_byte_shards": sharding.ORACLE_SQL,
    "op11_byte_spans": bytespans.ORACLE_SQL,
    "op12_collocations": phrases.ORACLE_SQL,
    "op13_annulus": centroids.ORACLE_SQL,
}
