"""Product catalog: alias -> product id, and the product dimension built from it.

The product name is the longest alias of an id in title case; ids without any alias
get no name (NULL), as in the source system.  The dimension is tiny and fixed in size
(one row per product), so it is joined by broadcast after aggregating by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the production alias map (alias -> product id), in its own order ---
PRODUCT_ALIASES = {
    "group health insurance": 1,
    "group health": 1,
    "ghi": 1,
    "group personal accident": 2,
    "group accident": 2,
    "group term life": 3,
    "group life": 3,
    "group travel insurance": 4,
    "group travel": 4,
    "fire": 5,
    "fire insurance": 5,
    "burglary insurance": 6,
    "burglary": 6,
    "office package policy": 7,
    "office package": 7,
    "shop owners insurance": 8,
    "shop owners": 8,
    "key man insurance": 10,
    "key man": 10,
    "group gratuity insurance": 11,
    "group gratuity": 11,
    "general liability": 12,
    "liability": 12,
    "marine insurance": 13,
    "marine": 13,
    "professional indemnity for doctors": 14,
    "doctors indemnity": 14,
    "directors officers liability": 15,
    "directors liability": 15,
    "construction all risk": 16,
    "construction risk": 16,
    "erection all risk": 17,
    "erection risk": 17,
    "plant machinery": 18,
    "plant": 18,
    "machinery": 18,
    "workmen compensation": 19,
    "workmen comp": 19,
    "workmen": 19,
    "wc": 19,
    "professional indemnity companies": 20,
    "company indemnity": 20,
    "cyber risk insurance": 21,
    "cyber insurance": 21,
    "cyber": 21,
    "commercial crime insurance": 22,
    "commercial crime": 22,
    "product liability": 23,
    "public liability": 24,
    "opd": 25,
    "event cancellation insurance": 26,
    "event cancellation": 26,
    "player loss of fees": 27,
    "custom duty package policy": 28,
    "custom duty": 28,
    "transport operators liability": 29,
    "transport liability": 29,
    "credit insurance": 32,
    "credit": 32,
    "group care policy covid": 33,
    "covid cover": 33,
    "fleet insurance": 34,
    "fleet": 34,
    "clinical trial insurance": 35,
    "clinical trial": 35,
    "group total protect policy": 36,
    "total protect": 36,
    "aviation insurance": 37,
    "aviation": 37,
    "electric equipment insurance": 38,
    "electric equipment": 38,
    "fidelity insurance": 39,
    "fidelity": 39,
    "industrial all risk insurance": 40,
    "industrial risk": 40,
    "kisan suvidha bima policy": 41,
    "kisan suvidha": 41,
    "pet insurance": 42,
    "pet": 42,
    "cattle insurance": 43,
    "cattle": 43,
    "boiler pressure plant insurance": 44,
    "boiler insurance": 44,
    "plate glass insurance": 45,
    "plate glass": 45,
    "all risks insurance": 46,
    "all risks": 46,
    "money insurance": 47,
    "money": 47,
    "others": 99,
    "edli scheme": 100,
    "affinity insurance": 102,
    "affinity": 102,
    "group health top up insurance": 103,
    "health top up": 103,
    "group term top up insurance": 104,
    "term top up": 104,
    "machinery breakdown": 106,
    "kidnap ransom extortion insurance": 110,
    "kidnap insurance": 110,
    "standard fire special perils": 112,
    "fire special perils": 112,
    "fire package policy": 113,
    "portable equipment insurance": 114,
    "portable equipment": 114,
    "jewellers block insurance": 115,
    "jewellers block": 115,
    "neon sign": 116,
    "drone insurance": 117,
    "drone": 117,
    "baggage": 119,
    "travel": 120,
    "petrol station package policy": 121,
    "petrol station": 121,
    "fire loss of profit": 122,
    "bharat griha raksha": 123,
    "special contingency policy": 184,
    "professional indemnity medical establishments": 185,
    "medical establishments indemnity": 185,
    "cyber risk insurance individuals": 186,
    "individual cyber": 186,
    "carrier legal liability": 187,
    "information communication technology liability": 188,
    "ict liability": 188
}
# --- end of fixed values ---

# Phrases meaning "every product"; a message holding one names no product.
ALL_PRODUCTS_PHRASES = ("all products", "all subproducts", "across products", "overall products",
                        "overall subproducts")

ALIAS_SCHEMA = T.StructType([T.StructField("alias", T.StringType(), False),
                             T.StructField("product_id", T.IntegerType(), False)])


def production_aliases(spark: SparkSession) -> DataFrame:
    """The production alias map as a DataFrame (alias, product_id)."""
    return spark.createDataFrame(list(PRODUCT_ALIASES.items()), ALIAS_SCHEMA)


def product_dim(aliases: DataFrame) -> DataFrame:
    """(product_id, product_name): the longest alias per id in title case.

    Equal-length aliases resolve to the alphabetically first one, so the name never
    depends on row order."""
    return (aliases.groupBy("product_id")
            .agg(F.min_by("alias", F.struct(-F.length("alias"), F.col("alias"))).alias("alias"))
            .select(F.col("product_id"), F.initcap(F.col("alias")).alias("product_name")))
