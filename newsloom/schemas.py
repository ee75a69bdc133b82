"""Explicit table schemas, checked at read; nothing here relies on inference."""

from pyspark.sql import types as T

ARTICLES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("titulo", T.StringType(), False),
    T.StructField("texto", T.StringType(), False),
    T.StructField("fuente", T.StringType(), False),
    T.StructField("hash_texto", T.StringType(), False),
    T.StructField("fecha_pub", T.StringType(), True),
    T.StructField("fecha_scrape", T.TimestampNTZType(), False),
])

ARTICLE_HISTORY = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("noticia_id", T.LongType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("titulo", T.StringType(), False),
    T.StructField("texto_anterior", T.StringType(), False),
    T.StructField("hash_anterior", T.StringType(), False),
    T.StructField("fecha_cambio", T.TimestampNTZType(), False),
])

INCOMING = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("titulo", T.StringType(), False),
    T.StructField("texto", T.StringType(), False),
    T.StructField("fuente", T.StringType(), False),
    T.StructField("fecha_pub", T.StringType(), True),
    T.StructField("seq", T.LongType(), False),
])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType(), False),
    T.StructField("url", T.StringType(), True),
    T.StructField("html", T.StringType(), True),
])

DOC_INDEX = T.StructType([
    T.StructField("doc_key", T.StringType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("document", T.StringType(), False),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("hash_texto", T.StringType(), True),
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
])

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType(), True),
    T.StructField("turn", T.LongType(), True),
    T.StructField("role", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("value", T.DoubleType(), True),
    T.StructField("props", T.StringType(), True),
])

RUNS = T.StructType([
    T.StructField("nuevas", T.LongType(), False),
    T.StructField("actualizadas", T.LongType(), False),
    T.StructField("sin_cambios", T.LongType(), False),
    T.StructField("errores", T.LongType(), False),
    T.StructField("inicio", T.TimestampNTZType(), False),
])
