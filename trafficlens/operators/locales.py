"""Locale dimension: locales, language codes, ISO languages, translators' names and countries, and joins on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Language codes and the locale each stands for.
CODES = """
aa am_ET  al sq_AL  am ku_IQ  ar ar_AE  au en_GB  az az_AZ  bg bg_BG  bn bn_BD  br pt_BR  bs bs_BA
by be_BY  ca en_CA  cn zh_CN  cs cs_CZ  da da_DK  de de_DE  el el_GR  en en_GB  gb en_GB  es es_ES
pe es_PE  et et_EE  fa fa_IR  fi fi_FI  fr fr_FR  he he_IL  hi hi_IN  hk zh_HK  hr hr_HR  ht ht_HT
hu hu_HU  hy hy_AM  id id_ID  in en_IN  iq ar_AE  is is_IS  it it_IT  ja ja_JP  ka ka_GE  km km_KH
ko ko_KR  ku ku_IR  kz kk_KZ  ln ln_CD  lo lo_LA  ky ky_KG  lt lt_LT  lv lv_LV  mk mk_MK  mn mn_MN
ms ms_MY  mx es_MX  my my_MM  nb nb_NO  ne ku_TR  nl nl_NL  nz en_NZ  pl pl_PL  pt pt_PT  ro ro_RO
ru ru_RU  sd ne_NP  si si_LK  sk sk_SK  sl sl_SI  sr sr_RS  sp sr_SP  sv sv_SE  sw sw_KE  th th_TH
te te_TE  tj tg_TJ  tl tl_PH  tr tr_TR  tw zh_TW  ua uk_UA  ur ur_PK  us en_GB  uz uz_UZ  vi vi_VN
ir fa_IR  zu ku_GE  kr ko_KR  zh zh_CN  tg tg_TJ  uk uk_UA  sq sq_AL  so so_SO  er aa_ER  ta ta_LK
"""
# Codes that only stand in for another code, and don't count as valid input.
ALIASES = "au gb iq us ir kr zh tg uk sq"
# Locales that no code stands for, with the code they map to.
MAPPED = {"aa_ET": "aa", "sd_IN": "sd", "zu_ZA": "zu"}
# Languages of locales that are not the locale's first part.
LANGUAGES = {"aa_ER": "zh", "ta_LK": "si", "sr_SP": "sp"}
# Locales that are no member of their language's list; the order of the lists that are not in table order.
UNLISTED = ("es_PE", "ku_GE", "ku_IQ", "ku_IR", "aa_ER", "ta_LK")
LISTS = {"en": ["en_GB", "en_CA", "en_IN", "en_NZ"], "zh": ["zh_CN", "zh_HK", "zh_TW"], "uz": ["uz_UZ", "uz_UZ"]}
# translators' names that are not the locale itself, and further names of a locale.
TRANSLATORS = {"am_ET": "aa_ET", "aa_ET": "aa_ET", "ku_TR": "ne_NP", "ku_GE": "zu_ZA", "ku_IQ": "am_ET", "ku_IR": "ku_TR", "ne_NP": "sd_IN", "sd_IN": "sd_IN", "zu_ZA": "zu_ZA"}
TRANSLATOR_ALIASES = {"tj_TJ": "tg_TJ", "uz_Latn": "uz_UZ", "uz_Latn_UZ": "uz_UZ"}
# Countries of language codes that are not the region of the code's locale.
COUNTRIES = {"am": "tr", "ku": "tr", "zu": "tr", "te": "in", "er": "cn", "sp": "rs"}
# Country codes beyond those of ISO 3166.
MORE_COUNTRIES = "ab ac an cs en gv nn os su tp uk xk yu"


def _pairs() -> list[tuple[str, str]]:
    words = CODES.split()
    return list(zip(words[::2], words[1::2]))


def rows() -> list[tuple[str, str, str, str]]:
    """(kind, code, target_kind, target) of all mappings."""
    pairs, aliases = _pairs(), set(ALIASES.split())
    code_of = {locale: code for code, locale in pairs if code not in aliases} | MAPPED
    language = lambda locale: LANGUAGES.get(locale, locale.split("_")[0])
    out = []
    lists: dict[str, list[str]] = {}
    for locale, code in sorted(code_of.items()):
        out.append(("locale", locale, "code", code))
        out.append(("locale", locale, "iso", language(locale)))
        out.append(("locale", locale, "translators", TRANSLATORS.get(locale, locale)))
        if locale not in UNLISTED:
            lists.setdefault(language(locale), []).append(locale)
    for iso, members in sorted((lists | LISTS).items()):
        out += [("iso", iso, "locale", m) for m in members]
    names = {TRANSLATORS.get(locale, locale): locale for locale in sorted(code_of) if locale not in MAPPED}
    out += [("translators", name, "locale", locale) for name, locale in sorted((names | TRANSLATOR_ALIASES).items())]
    for code, locale in pairs:
        out.append(("code", code, "locale", locale))
        out.append(("code", code, "iso", language(locale)))
        out.append(("code", code, "country", COUNTRIES.get(code, locale.split("_")[1].lower())))
    return out


def dimension(spark: SparkSession) -> DataFrame:
    """All mappings as a table; a few hundred rows of fixed size."""
    return spark.createDataFrame(rows(), "kind string, code string, target_kind string, target string")


def countries(spark: SparkSession) -> DataFrame:
    """Country codes: those of ISO 3166 as the JVM lists them, and MORE_COUNTRIES."""
    iso = [c.lower() for c in spark.sparkContext._jvm.java.util.Locale.getISOCountries()]
    return spark.createDataFrame([(c,) for c in sorted({*iso, *MORE_COUNTRIES.split()})], "country string")


def translate(df: DataFrame, column: str, kind: str, target_kind: str, out: str, dim: DataFrame) -> DataFrame:
    """Add `out`: what `column`'s value maps to; null for a value that is unknown. ISO languages map to an array, as one
    has several locales; unknown ones map to an empty array."""
    wanted = dim.where((F.col("kind") == kind) & (F.col("target_kind") == target_kind))
    many = kind == "iso"
    target = F.sort_array(F.collect_list("target")) if many else F.first("target")
    table = wanted.groupBy(F.col("code").alias("__code")).agg(target.alias(out))
    joined = df.join(F.broadcast(table), F.col(column) == F.col("__code"), "left").drop("__code")
    return joined.withColumn(out, F.coalesce(out, F.array().cast("array<string>"))) if many else joined


def valid(df: DataFrame, column: str, kind: str, out: str, dim: DataFrame) -> DataFrame:
    """Add `out`: whether the value is one of its kind. Aliases are not."""
    aliases = [*ALIASES.split()] if kind == "code" else list(TRANSLATOR_ALIASES) if kind == "translators" else []
    known = dim.where((F.col("kind") == kind) & ~F.col("code").isin(aliases)).select(F.col("code").alias("__code")).distinct()
    return df.join(F.broadcast(known), F.col(column) == F.col("__code"), "left").withColumn(out, F.col("__code").isNotNull()).drop("__code")


def roundtrip_gaps(dim: DataFrame) -> DataFrame:
    """Locales that are not what their language code, or their translators' name, maps back to."""
    there = dim.where("kind = 'locale' AND target_kind IN ('code', 'translators')").select(F.col("code").alias("locale"), F.col("target_kind").alias("by"), "target")
    back = dim.where("target_kind = 'locale' AND kind IN ('code', 'translators')").select(F.col("kind").alias("by"), F.col("code").alias("target"), F.col("target").alias("back"))
    return there.join(back, ["by", "target"], "left").where(~F.col("locale").eqNullSafe(F.col("back"))).select("locale", "by", "target", "back")
