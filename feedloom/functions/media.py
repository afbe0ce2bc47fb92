"""Enclosures and icons: kinds by MIME type, the one that a player takes, data URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# MIME types that an icon may have, and endings of image files.
ICON_TYPES = ("image/png", "image/jpeg", "image/jpg", "image/webp", "image/svg+xml", "image/x-icon", "image/gif")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png", ".gif")


def is_audio(mime_type: Column) -> Column:
    return F.lower(mime_type).startswith("audio/")


def is_video(mime_type: Column) -> Column:
    return F.lower(mime_type).startswith("video/")


def is_image(mime_type: Column, url: Column) -> Column:
    """By type, or by the ending of the URL."""
    found = F.lower(mime_type).startswith("image/")
    for ending in IMAGE_ENDINGS:
        found = found | F.lower(url).endswith(ending)
    return found


def html5_type(mime_type: Column) -> Column:
    return F.when(mime_type == "video/m4v", "video/x-m4v").otherwise(mime_type)


def playable(enclosures: Column) -> Column:
    """The first of an array of enclosures (url, mime_type, ...) that is audio or video and has a URL; else null."""
    return F.get(F.filter(enclosures, lambda x: (x["url"] != "") & (is_audio(x["mime_type"]) | is_video(x["mime_type"]))), 0)


def has_media(enclosures: Column) -> Column:
    return F.exists(enclosures, lambda x: is_audio(x["mime_type"]) | is_video(x["mime_type"]))


def icon_type(mime_type: Column) -> Column:
    """The type in lower case if an icon may have it, else image/x-icon."""
    t = F.lower(mime_type)
    return F.when(t.isin(*ICON_TYPES), t).otherwise("image/x-icon")


def data_url(mime_type: Column, content: Column) -> Column:
    return F.concat(mime_type, F.lit(";base64,"), F.base64(content))
