"""Partner trust property.

Trust values live in a polymorphic property table keyed by the string
``'res.partner,<partner id>'`` plus a company.  Joining on that string would
hash a freshly built string for every line.  Instead the property side is
turned into an integer partner key once: a row keeps its key only when the
string is exactly ``'res.partner,'`` followed by the canonical decimal form
of that key, which makes the integer equi-join equivalent to the string one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import partner_res_id


def trust_properties(ir_property: DataFrame, model: str = "res.partner",
                     name: str = "trust") -> DataFrame:
    """``(trust_partner_id, trust_company_id, trust_property_id, trust_value)``."""
    prefix = model + ","
    res_id = F.col("res_id")
    key = F.substr(res_id, F.lit(len(prefix) + 1)).try_cast("bigint")
    return (ir_property
            .filter((F.col("name") == name) & res_id.startswith(prefix))
            .select(key.alias("trust_partner_id"), "res_id",
                    F.col("company_id").alias("trust_company_id"),
                    F.col("id").alias("trust_property_id"),
                    F.col("value_text").alias("trust_value"))
            .filter(F.col("res_id") == partner_res_id(F.col("trust_partner_id"), model))
            .drop("res_id"))


def join_trust(df: DataFrame, ir_property: DataFrame, partner_col: str = "partner_id",
               company_col: str = "company_id") -> DataFrame:
    """Left join of the trust rows of (partner, company), as private columns
    ``__trust_id`` and ``__trust_value``; several trust rows for one pair give
    several output rows, none gives nulls.

    A plain shuffled join on both keys: each side has an exchange of its own,
    so AQE splits a partner with very many lines, and broadcasts the property
    side when its real size is small.
    """
    t = trust_properties(ir_property).select(
        F.col("trust_partner_id").alias("__t_partner"), F.col("trust_company_id").alias("__t_company"),
        F.col("trust_property_id").alias("__trust_id"), F.col("trust_value").alias("__trust_value"))
    cond = (F.col(partner_col) == F.col("__t_partner")) & (F.col(company_col) == F.col("__t_company"))
    return df.join(t, cond, "left").drop("__t_partner", "__t_company")
