"""Public corpora that the builders read, as tables. Fetching them is ingest's business."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_HOST = "https://object.pouta.csc.fi"
#: Version folders of the English-Ukrainian archives by collection.
MOSES = {
    "ParaCrawl": "v9", "WikiMatrix": "v1", "TED2020": "v1", "Tatoeba": "v2023-04-12", "EUbookshop": "v2", "CCAligned": "v1", "OpenSubtitles": "v2024", "wikimedia": "v20230407",
    "XLEnt": "v1.2", "QED": "v2.0a", "bible-uedin": "v1", "Ubuntu": "v14.10", "KDE4": "v2", "GNOME": "v1", "MaCoCu": "v2",
}

#: Data ids (without their language pair) of the constrained recipes, by provider.
RECIPES = {
    "ces-ukr": {
        "ELRC": "acts_ukrainian-1",
        "Facebook": "wikimatrix-1",
        "OPUS": "bible_uedin-v1 ccmatrix-v1 elrc_5179_acts_ukrainian-v1 elrc_wikipedia_health-v1 eubookshop-v2 gnome-v1 kde4-v2 multiccaligned-v1.1 multiparacrawl-v9b opensubtitles-v2024 qed-v2.0a tatoeba-v20220303 ted2020-v1 ubuntu-v14.10 wikimedia-v20210402 xlent-v1.1",
    },
    "eng-ukr": {
        "ELRC": "a_lexicon_named_entities_extracted_wikipedia-1 acts_ukrainian-1 french_polish_ukrainian-1 hrw_dataset_v1-1 official_parliament_ukraine_abstracts_uk_laws-1 official_parliament_ukraine_primary_legislation-1 official_parliament_ukraine_ukrainian_laws_en-1 scipar_ukraine-1 ukrainian_legal_mt_test_set-1 web_acquired_data_related_to_scientific_research-1 wikipedia_health-1",
        "Facebook": "wikimatrix-1",
        "Neulab": "tedtalks_train-1",
        "OPUS": "bible_uedin-v1 ccaligned-v1 ccmatrix-v1 elrc_2922-v1 elrc_3043_wikipedia_health-v1 elrc_5174_french_polish_ukrain-v1 elrc_5179_acts_ukrainian-v1 elrc_5180_official_parliament_-v1 elrc_5181_official_parliament_-v1 elrc_5182_official_parliament_-v1 elrc_5183_scipar_ukraine-v1 elrc_5214_a_lexicon_named-v1 elrc_5217_ukrainian_legal_mt-v1 elrc_wikipedia_health-v1 eubookshop-v2 gnome-v1 hplt-v2 kde4-v2 kdedoc-v1 macocu-v2 multiccaligned-v1 multihplt-v2 multimacocu-v2 neulab_tedtalks-v1 nllb-v1 opensubtitles-v2024 paracrawl_bonus-v9 qed-v2.0a summa-v1 tatoeba-v20230412 ted2020-v1 tldr_pages-v20230829 ubuntu-v14.10 wikimatrix-v1 wikimedia-v20230407 xlent-v1.2",
        "ParaCrawl": "paracrawl-1_bonus",
        "Statmt": "ccaligned-1",
        "Tilde": "worldbank-1",
    },
    "ukr": {
        "LangUk": "fiction-1 laws-1 news-1 ubercorpus-1 wiki_dump-1",
        "Leipzig": "news-2022_1m newscrawl-2018_1m web-2019_1m wikipedia-2021_1m",
        "Statmt": "news_crawl-2023",
    },
}


def moses(spark: SparkSession, pair: str = "en-uk") -> DataFrame:
    """name, url of the archives of aligned files."""
    return spark.createDataFrame([(f"{k.lower()}_{v}", f"{_HOST}/OPUS-{k}/{v}/moses/{pair}.txt.zip") for k, v in MOSES.items()], "name string, url string")


def recipe(spark: SparkSession, languages: str) -> DataFrame:
    """provider, dataset of a pair's recipe (or of one language's texts)."""
    return spark.createDataFrame([(p, x) for p, names in RECIPES[languages].items() for x in names.split()], "provider string, dataset string")
