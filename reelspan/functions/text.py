"""Text, path, JSON and array functions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File name extensions that count as media.
MEDIA_EXTENSIONS = ["mp4", "mkv", "mov", "avi", "webm", "flv", "wmv", "m4v", "mp3", "wav", "aac", "flac", "ogg", "m4a", "wma"]
#: Languages that transcripts are translated to.
LANGUAGES = ["English", "Spanish", "French", "German", "Italian", "Portuguese", "Dutch", "Russian", "Japanese", "Chinese", "Korean", "Hindi", "Arabic", "Turkish", "Polish"]
#: Fixed value: the host whose API takes its key in the address.
KEYED_HOST = "generativelanguage.googleapis.com"
#: Models offered where a listing fails, for the keyed host and for all others.
FALLBACK_MODELS = {True: ["gemini-2.0-flash", "gemini-1.5-pro", "gemini-1.5-flash"], False: ["gpt-4", "gpt-3.5-turbo"]}

SEGMENT_JSON = "array<struct<start:string,end:string,speaker:string,text:string>>"


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^.]+)$", 1)


def is_media(path: Column) -> Column:
    return extension(path).isin(MEDIA_EXTENSIONS)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^/\\.]+$", "")


def subtitle_path(path: Column, language: Column, kind: str) -> Column:
    tag = F.when(language.isNull() | language.isin("", "Original"), F.lit("")).otherwise(F.concat(F.lit("."), language))
    return F.concat(without_extension(path), tag, F.lit(f".{kind}"))


def cut_path(path: Column) -> Column:
    """``_cut`` before the extension, or at the end where there is none, so that the input is never the output."""
    ext = F.regexp_extract(path, r"(\.[^/\\.]+)$", 1)
    return F.concat(without_extension(path), F.lit("_cut"), ext)


def _bare(path: Column) -> Column:
    """Without the extension of the file name; a name that only begins with a dot has none."""
    return F.regexp_replace(path, r"(?<=[^/\\])\.[^/\\.]*$", "")


def audio_path(path: Column) -> Column:
    """Where the sound of a media goes that is sent to a model: beside it, as Ogg."""
    return F.concat(_bare(path), F.lit(".ogg"))


def nosilence_path(path: Column) -> Column:
    """Where the sound goes once silences are cut out."""
    return F.concat(_bare(path), F.lit("_nosilence.ogg"))


def clips_dir(path: Column) -> Column:
    return F.concat(without_extension(path), F.lit("_clips"))


def clean_label(label: Column) -> Column:
    """Letters, numbers, ``-`` and ``_`` of any script."""
    return F.regexp_replace(label, r"[^\p{IsAlphabetic}\p{N}_-]", "")


def clip_filename(index: Column, label: Column) -> Column:
    """clip_NNN[_label].mp4 for a clip's 0-based index."""
    from .timecode import padded

    cleaned = F.coalesce(clean_label(label), F.lit(""))
    return F.concat(F.lit("clip_"), padded(index + 1, 3), F.when(cleaned != "", F.concat(F.lit("_"), cleaned)).otherwise(""), F.lit(".mp4"))


def bracketed(reply: Column) -> Column:
    """From the first ``[`` to the last ``]``; null if there is no such stretch."""
    found = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def segments_of(json: Column, strict: bool = False) -> Column:
    """A JSON array of segments; null if it is malformed and, with ``strict``, if any segment lacks a field."""
    rows = F.from_json(json, SEGMENT_JSON)
    if not strict:
        return rows
    return F.when(F.forall(rows, lambda s: s.isNotNull() & s["start"].isNotNull() & s["end"].isNotNull() & s["speaker"].isNotNull() & s["text"].isNotNull()), rows)


def saved_segments(document: Column) -> Column:
    """Segments of a saved transcript, which is an array of them or an object that may have one; null if malformed or without."""
    is_list = F.substring(F.ltrim(document), 1, 1) == "["
    return F.when(is_list, F.from_json(document, SEGMENT_JSON)).otherwise(F.from_json(document, f"struct<segments:{SEGMENT_JSON},context:string>")["segments"])


def saved_context(document: Column) -> Column:
    return F.when(F.substring(F.ltrim(document), 1, 1) != "[", F.from_json(document, f"struct<segments:{SEGMENT_JSON},context:string>")["context"])


def keyed_provider(base_url: Column) -> Column:
    return F.contains(base_url, F.lit(KEYED_HOST))


def normal_base_url(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), "/+$", "")
    return F.when(F.rlike(bare, F.lit("^https?://")), bare).otherwise(F.concat(F.lit("https://"), bare))


def model_names(listing: Column, keyed: Column) -> Column:
    """Names in a model listing of either shape, without empty ones; the fallback list where there are none."""
    data = F.from_json(listing, "struct<models:array<struct<name:string>>,data:array<struct<id:string>>>")
    plain = F.transform(data["models"]["name"], lambda n: F.when(F.regexp_replace(n, "^(.*?)models/", "$1") != "", F.regexp_replace(n, "^(.*?)models/", "$1")).otherwise(n))
    found = F.filter(F.coalesce(plain, data["data"]["id"]), lambda n: n.isNotNull() & (n != ""))
    fallback = F.when(keyed, F.array(*map(F.lit, FALLBACK_MODELS[True]))).otherwise(F.array(*map(F.lit, FALLBACK_MODELS[False])))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words, in lower case; 1 if neither text has any."""
    x, y = word_set(a), word_set(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(x, y)), union))


def argmax(values: Column) -> Column:
    """struct(index, value) of the first largest number; not-a-number never wins, and nothing gives (0, -Infinity)."""
    low = F.lit(float("-inf"))
    usable = F.transform(values, lambda v: F.when(F.isnan(v) | v.isNull(), low).otherwise(v.cast("double")))
    best = F.coalesce(F.array_max(usable), low)
    place = F.when(best > low, F.array_position(usable, best) - 1).otherwise(0).cast("long")
    return F.struct(place.alias("index"), best.alias("value"))


def words_of_tokens(tokens: Column) -> Column:
    """Text of decoded tokens: special tokens (``<...``) and unknown ones are dropped, a leading space begins a word."""
    plain = F.filter(tokens, lambda t: t.isNotNull() & ~F.startswith(t, F.lit("<")))
    # spaces inside tokens are kept apart from those that begin words
    marked = F.array_join(F.transform(plain, lambda t: F.when(F.startswith(t, F.lit(" ")), F.concat(F.lit("\x00"), F.substr(t, F.lit(2)))).otherwise(t)), "")
    return F.array_join(F.filter(F.split(marked, "\x00"), lambda w: w != ""), " ")


def base64_of(content: Column) -> Column:
    """Standard base64 on one line, whatever the session says about line breaks."""
    return F.regexp_replace(F.base64(content), r"[\r\n]", "")


def megabytes(size: Column) -> Column:
    return F.round(size / 1048576, 2)


def without_fillers(text: Column) -> Column:
    """An extension: filler words taken out by pattern, where the original only asks a model to."""
    out = F.regexp_replace(text, r"(?i)(?<![\p{L}\p{N}_])(?:um+|uh+|erm?|hmm+|mhm)(?![\p{L}\p{N}_])[,.]?\s*", "")
    return F.trim(F.regexp_replace(out, r" {2,}", " "))


def transcript_line(start: Column, end: Column, speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("["), start, F.lit("-"), end, F.lit("] "), speaker, F.lit(": "), text)
