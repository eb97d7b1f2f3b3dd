"""Data model: one fingerprint a row, words as non-negative BIGINT (unsigned 32- and 16-bit values)."""

from pyspark.sql import types as T

R_WORDS, DOM_WORDS, CPRINT_NOMINAL = 87, 33, 948
MATCH_SCORE, EQUAL_SCORE = 0.6, 0.98

#: Least low-bit share that a score above 0.6 needs with fm = 1 (solved from the blend polynomial).
MATCH_CP = 0.854347911716833

FINGERPRINT = T.StructType([
    T.StructField("songlen", T.LongType()), T.StructField("bit_rate", T.LongType()), T.StructField("num_errors", T.LongType()),
    T.StructField("r32", T.ArrayType(T.LongType())), T.StructField("dom16", T.ArrayType(T.LongType())), T.StructField("cprint", T.ArrayType(T.LongType())),
])
FIELDS = FINGERPRINT.fieldNames()
