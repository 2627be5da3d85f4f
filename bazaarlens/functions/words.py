"""Word lists that define the semantics of matching. Fixed values."""

STOPWORDS = [
    "termos", "matara", "bardak", "mug", "kupa", "pipetli", "paslanmaz", "celik", "fiyatlari", "ozellikleri", "the", "ve", "ile", "lt", "litre", "liter", "ml", "oz",
    "suluk", "bottle", "tumbler", "classic", "klasik", "renk", "renkli",
]

VOLUME_CONTEXT = ["termos", "matara", "bardak", "mug", "kupa", "bottle", "suluk", "tumbler", "iceflow", "aerolight", "fliptop", "quencher"]

#: The family of each colour word.
COLOUR_FAMILY = {
    "siyah": "black", "black": "black",
    "beyaz": "white", "white": "white",
    "krem": "cream", "cream": "cream", "bej": "cream", "beige": "cream",
    "pembe": "pink", "pink": "pink", "rose": "pink", "quartz": "pink",
    "mavi": "blue", "blue": "blue", "azure": "blue",
    "lacivert": "navy", "navy": "navy",
    "yesil": "green", "green": "green", "mint": "green",
    "haki": "khaki", "khaki": "khaki",
    "gri": "gray", "gray": "gray", "grey": "gray",
    "mor": "purple", "purple": "purple", "leylak": "purple", "lilac": "purple",
    "bordo": "burgundy",
    "kirmizi": "red", "red": "red",
    "turuncu": "orange", "orange": "orange",
    "mercan": "coral", "coral": "coral", "somon": "coral",
    "sari": "yellow", "yellow": "yellow",
    "kahverengi": "brown", "brown": "brown",
    "gold": "gold", "altin": "gold",
    "gumus": "silver", "silver": "silver",
}

#: Endings that shops add to a title.
TITLE_SUFFIXES = [" Fiyatları ve Özellikleri", " Fiyatlari ve Ozellikleri"]
