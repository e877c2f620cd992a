"""Schemas and fixed dictionaries."""

from __future__ import annotations

from pyspark.sql import types as T

# Pulse classes by id, and how many samples and classes each kind of data has.
SIGNAL_CLASSES = {
    0: "coherent_pulse_train",
    1: "barker_code",
    2: "polyphase_barker_code",
    3: "frank_code",
    4: "linear_frequency_modulated",
}
IQ_SAMPLES, IQ_CLASSES = 512, 5
IMAGE_PIXELS, IMAGE_CLASSES = 784, 10

#: A frame: an order key, real-stacked samples [re..., im...] or pixels, and a class.
FRAME = T.StructType(
    [
        T.StructField("row_id", T.LongType(), False),
        T.StructField("x", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("label", T.IntegerType(), False),
    ]
)
BANK = T.StructType(
    [
        T.StructField("ref_index", T.LongType(), False),
        T.StructField("z", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("label", T.IntegerType(), False),
    ]
)
EPOCHS = "epoch int, train_mse double, val_mse double, train_ce double, val_ce double"
