"""Schemas of the document model."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = ["id", "source", "source_id", "texto", "sumario", "caratula", "tipo_documento", "tipo_fallo", "tribunal", "tipo_tribunal", "sala", "materia", "fecha", "jurisdiccion", "provincia", "localidad", "actor", "demandado", "sobre", "texto_embedding"]
_LISTS = ["magistrados", "voces", "descriptores", "referencias_normativas", "citas_jurisprudenciales"]

#: The normalised document; absent texts are empty and absent lists have no elements.
DOCUMENT = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT] + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS] + [T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType())]
)

#: What a reader says about one document.
ANALYSIS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("caratula", "tribunal", "fecha", "resultado", "via_procesal", "doctrina_aplicada", "hechos_determinantes", "prueba_decisiva", "quantum", "votos", "estrategia", "argumento_clave", "razon_resultado", "relevancia_cliente", "source_id", "agent_thinking", "reasoning")]
    + [T.StructField("normas_citadas", T.ArrayType(T.StringType())), T.StructField("precedentes_citados", T.ArrayType(T.StringType())), T.StructField("score", T.DoubleType())]
)

USAGE = "id string, user_id string, tool string, tier string, input_tokens int, output_tokens int, cost_usd decimal(10,6), reader_model string, synth_model string, fallos_analyzed int, duration_seconds int, created_at timestamp"
SAVED_ITEM = "id string, user_id string, type string, title string, data string, created_at timestamp"

#: Domains of the enumerated columns.
TIERS = ("premium", "standard", "economy")
ITEM_TYPES = ("analisis", "escrito", "jurisprudencia", "resumen")
