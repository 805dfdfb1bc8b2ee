"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

DOCUMENTS = _schema(doc_id=_L, lang=_S, text=_S)
TOKENS = _schema(doc_id=_L, lang=_S, tok_id=_I, token=_S, start=_L, end=_L, sent_id=_L)
ANCHORS = _schema(lang=_S, surface=_S, title=_S)
PAGES = _schema(page_id=_L, ns=_I, title=_S, is_redirect=_I)
REDIRECTS = _schema(page_id=_L, target_title=_S)
LANGLINKS = _schema(page_id=_L, lang=_S, title=_S)
TITLE2MID = _schema(title=_S, lang=_S, mid=_S)
VECTORS = _schema(key=_S, vec=T.ArrayType(T.FloatType()))
MENTIONS = _schema(
    doc_id=_L, start=_I, end=_I, surface=_S, mention_type=_S, wiki_title=_S, en_title=_S, mid=_S, confidence=_D, ngram=_I, is_stop=_B, noun_type=_S
)
GOLD_MENTIONS = _schema(id=_S, surface=_S, doc_name=_S, start=_L, end=_L, mid=_S, mention_type=_S, noun_type=_S, lang=_S)
SEARCH_CACHE = _schema(lang=_S, mode=_S, query=_S, titles=T.ArrayType(_S))
ERE_MENTIONS = _schema(doc_name=_S, entity_id=_S, mention_id=_S, mention_type=_S, noun_type=_S, start=_I, end=_I, surface=_S)
