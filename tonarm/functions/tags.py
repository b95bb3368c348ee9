"""Tag lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Variants of tags and the tag that stands for them, by category. No canonical tag is a variant itself.
TAG_MAP = {
    "genre": {
        "punk": "punkrock", "eletronica": "electronica", "soundtracks": "soundtrack", "electronical": "electronic", "electronik": "electronic",
        "electronicmusic": "electronic", "rockpop": "poprock", "rockandroll": "rocknroll", "ambiente": "ambient", "ambiant": "ambient",
        "popelectro": "electropop", "houseelectro": "electrohouse", "rhythmandblues": "rnb", "dancemusic": "dance", "folkpop": "popfolk",
        "loungemusic": "lounge", "housemusic": "house", "trancemusic": "trance", "ambientmusic": "ambient", "prog": "progressive",
        "electronicambient": "electroambient", "classicalmusic": "classical", "electronika": "electronica", "raps": "rap", "tecno": "techno",
        "rockalternatif": "alternativerock", "hiphopinstrumental": "instrumentalhiphop",
    },
    "mood/theme": {
        "dreamy": "dream", "emotion": "emotional", "filmmusic": "film", "energic": "energetic", "energy": "energetic", "inspirational": "inspiring",
        "lovesong": "love", "melancholy": "melancholic", "relaxed": "relaxing", "melancolic": "melancholic", "sadness": "sad", "filmscore": "film",
        "romance": "romantic", "hope": "hopeful", "motivation": "motivational", "happiness": "happy", "sports": "sport", "cinema": "film",
        "relaxation": "relaxing", "child": "children", "kids": "children", "relaxingmusic": "relaxing", "trailermusic": "trailer", "lovemusic": "love",
        "joy": "joyful", "xmas": "christmas", "epicmusic": "epic", "motivate": "motivational", "darkness": "dark", "sciencefiction": "scifi",
        "festif": "festive",
    },
    "instrument": {
        "synth": "synthesizer", "drum": "drums", "string": "strings", "guitars": "guitar", "synths": "synthesizer", "pianosolo": "piano", "sax": "saxophone",
        "guitare": "guitar", "synthesizers": "synthesizer", "beats": "beat", "violins": "violin", "bells": "bell", "percussions": "percussion",
        "choirs": "choir", "pads": "pad", "flutes": "flute", "electricguitars": "electricguitar", "synthetizer": "synthesizer", "keyboards": "keyboard",
        "horns": "horn", "guitares": "guitar", "guitareelectrique": "electricguitar", "guitarra": "guitar", "batterie": "drums", "keys": "keyboard",
        "bongos": "bongo", "synthé": "synthesizer", "accordeon": "accordion", "violons": "violin", "violon": "violin", "pianoforte": "piano",
        "pianos": "piano", "chitarra": "guitar", "basso": "bass", "synthetiseur": "synthesizer", "batteria": "drums", "bateria": "drums", "bajo": "bass",
        "synthetiseurs": "synthesizer", "claviers": "clavier", "teclados": "keyboard",
    },
}
MAX_TAGS = 7


def tag_map(category: str) -> dict[str, str]:
    return dict(TAG_MAP[category])


def gather_tags(*slots: Column) -> Column:
    """One list of tag slots: nulls go, order and repeats stay."""
    return F.filter(F.array(*slots), lambda t: t.isNotNull())


def strip_prefix(tags: Column, category: str) -> Column:
    return F.transform(tags, lambda t: F.replace(t, F.lit(f"{category}---"), F.lit("")))


def canonical(tags: Column, mapping: dict[str, str]) -> Column:
    """Lower-case, variants replaced, repeats dropped after the first; without a shuffle."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.array_distinct(F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, F.lower(t)), F.lower(t))))


def tags_text(tags: Column) -> Column:
    """A tag list as text: empty tags skipped, null is empty."""
    return F.coalesce(F.array_join(F.filter(tags, lambda t: t != ""), " "), F.lit(""))


def combined_text(caption: Column, *tag_lists: Column, use_tags: bool = True) -> Column:
    said = F.trim(F.coalesce(caption, F.lit("")))
    if not use_tags:
        return said
    tags = F.concat_ws(" ", *[F.nullif(tags_text(t), F.lit("")) for t in tag_lists])
    return F.when(tags != "", F.concat(said, F.lit(" | tags: "), tags)).otherwise(said)


def list_from_text(c: Column) -> Column:
    """A list from its text form (single or double quotes), null where it is none."""
    return F.when(c.rlike(r"^\s*\["), F.from_json(c, "array<string>"))


def text_of_list(c: Column) -> Column:
    """A list in text form as plain text; text that is no list is kept as it is, null is empty."""
    return F.coalesce(F.nvl2(list_from_text(c), tags_text(list_from_text(c)), c), F.lit(""))
