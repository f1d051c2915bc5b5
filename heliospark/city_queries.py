"""Names in Cyrillic letters and metres of the map's projection, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliospark import constants as C
from heliospark.functions import geo, text
from heliospark.queries import dbl, fold_sql, load, query

NAMES = ["Қабанбай Батыр", "Әл-Фараби", "Бейбітшілік", "Ұлы Дала", "Мәңгілік Ел", "Хан Шатыр", "Ғылым үйі", "Һәм Өзен", "Щучье: Ёлка", "Юность, Эра", "Цех, чай и съезд", "Жыл_Маңы"]
NAME_SQL = f"concat({NAMES}[p_partkey % {len(NAMES)} + 1], ' ', {C.STREET_WORDS}[p_partkey % {len(C.STREET_WORDS)} + 1], ' ', p_partkey % 100)"
LATIN_SQL = fold_sql("name")
for _a, _b in [*C.LATIN.items(), *C.COLLAPSE]:
    LATIN_SQL = f"replace({LATIN_SQL}, '{_a}', '{_b}')"


@query(f"select p_partkey, {fold_sql('name')} as folded, {LATIN_SQL} as latin from (select p_partkey, {NAME_SQL} as name from part)")
def cyrillic_names(s, d):
    """Kazakh and Russian names with all kinds of street words, folded and in Latin letters."""
    k = F.col("p_partkey")
    of = lambda words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    name = F.concat(of(NAMES), F.lit(" "), of(C.STREET_WORDS), F.lit(" "), k % 100)
    return load(s, d, "part").select("p_partkey", text.fold(name).alias("folded"), text.latinise(name).alias("latin"))


def _series(at: str, other: str) -> str:
    return " + ".join(f"{a!r}::double * {at.format(2 * j)} * {other.format(2 * j)}" for j, a in enumerate(geo._ALPHA, 1))


@query(f"""with g as (select c_custkey, radians(50 + c_custkey % 977 / 977.0::double) as phi, radians(70 + c_custkey * 7 % 1009 / 500.0::double - 69) as dl from customer),
  t as (select *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) as t from g, (select sqrt(f * (2 - f)) as e from (select 1 / 298.257223563::double as f))),
  x as (select *, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + t * t)) as eta from t)
  select c_custkey, round(500000 + 0.9996::double * {geo._A!r}::double * (eta + {_series("cos({0} * xi)", "sinh({0} * eta)")}), 3) as x, round(0.9996::double * {geo._A!r}::double * (xi + {_series("sin({0} * xi)", "cosh({0} * eta)")}), 3) as y from x""")
def projected_metres(s, d):
    """Metres east and north in the zone of the city."""
    k = F.col("c_custkey")
    p = load(s, d, "customer").select("c_custkey", geo.to_utm(50 + dbl(k % 977) / 977, 70 + dbl(k * 7 % 1009) / 500).alias("p"))
    return p.select("c_custkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))
