"""Queries over binary files that tasks write from the tables, and over JSON of any depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions.json_leaves import leaves
from ..operators.storage import fresh_folder
from ..sources import tensors as T
from ..sources.tables import RECIPES_SQL, recipes, table


@query("src06_safetensors", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last FROM embeddings""")
def src06_files(spark, d):
    uri = fresh_folder(spark, "tensors")
    T.write_safetensors(table(spark, d, "embeddings"), uri, "vec_id", "embedding")
    ids = T.read_safetensors(spark, uri, "ids").select("file", "row", F.element_at("values", 1).cast("long").alias("vec_id"))
    v = F.col("values")
    return ids.join(T.read_safetensors(spark, uri, "matrix"), ["file", "row"]).select(
        "vec_id", F.size(v).alias("dims"), F.element_at(v, 1).alias("first"), F.element_at(v, -1).alias("last"))


@query("src08_file_checksums", """
SELECT p_size, CAST(sum(octet_length(encode(p_name)) + 1) AS BIGINT) AS bytes, sha256(string_agg(p_name || chr(10), '' ORDER BY p_partkey)) AS sha256 FROM part GROUP BY p_size""")
def src08_files(spark, d):
    """A text file per size of parts; their checksums are taken of the files and checked once more."""
    uri = fresh_folder(spark, "pinned")
    parts = table(spark, d, "part").select("p_size", "p_partkey", "p_name")
    sizes = parts.select("p_size").distinct().count()  # fifty sizes
    parts.repartition(sizes, "p_size").sortWithinPartitions("p_size", "p_partkey").select("p_size", "p_name").write.partitionBy("p_size").text(uri)
    paths = [r.path for r in spark.read.format("binaryFile").load(f"{uri}/*/part-*").select("path").collect()]
    found = T.file_checksums(spark, paths)
    checked = T.verified(found, T.file_checksums(spark, paths).select("path", "sha256"))
    return checked.select(F.regexp_extract("path", "p_size=([0-9]+)", 1).cast("int").alias("p_size"), "bytes", "sha256")


@query("nst09_recursive_leaves", f"""
WITH {RECIPES_SQL}, n AS (SELECT source_id, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS i FROM recipes)
SELECT source_id, '$.recipe.title' AS path, 'string' AS kind, title AS value FROM recipes
UNION ALL SELECT source_id, '$.recipe.servings', 'integer', CAST(CAST(servings AS BIGINT) AS VARCHAR) FROM recipes
UNION ALL SELECT source_id, '$.recipe.lines[' || i || '].name', 'string', name FROM n
UNION ALL SELECT source_id, '$.recipe.lines[' || i || ']["red one"]', 'boolean', CAST(name LIKE 'red %' AS VARCHAR) FROM n
UNION ALL SELECT source_id, '$.recipe.lines[' || i || '].words[' || k || ']', 'string', string_split(name, ' ')[k + 1] FROM n, range(2) t(k)
UNION ALL SELECT source_id, '$.scope.data', 'string', dataset_id FROM recipes""")
def nst09_recursive(spark, d):
    lines = F.transform("names", lambda n: F.struct(n.alias("name"), n.startswith("red ").alias("red one"), F.split(n, " ").alias("words")))
    whole = F.struct(
        F.struct("title", F.col("servings").cast("long").alias("servings"), lines.alias("lines")).alias("recipe"), F.struct(F.col("dataset_id").alias("data")).alias("scope"))
    texts = recipes(spark, d).select("source_id", F.to_json(whole).alias("json"))
    return leaves(texts, ["source_id"], "json").select("source_id", "path", "kind", "value")
