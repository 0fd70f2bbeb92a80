"""Records of an invented coast, written from the rules they exercise.

``ACCEPTED`` and ``DUPLICATES`` are positions in ``MESSY``; all others are refused.
"""

MESSY = [
    {"source_name": "Orbit Weekly", "headline": "Comet brightens", "body": "<ul><li>Green</li><li>tail</li></ul><noscript>off</noscript>",
     "link": "http://www.orbitweekly.net:80/sky/comet/?gclid=1&lang=en", "publishedAt": "2023-10-07 21:05:30", "reach": "98 765"},
    {"source": "Reef Radio", "text": "Tides rise tonight", "created_at": 1696712400000, "views": 17},
    {"headline": "Nobody said it", "body": "words"},
    {"source": "REEF RADIO!", "content": "Tides   rise, tonight."},
    {"publisher": "hutan-lestari.or.id", "title": "Hujan tiba", "description": "Musim hujan &quot;tiba&quot;",
     "permalink": "https://hutan-lestari.or.id/berita#2", "date": "7 Okt 2023", "engagement_count": "2,5 ribu"},
    {"source": "orbitweekly.net", "headline": "Comet brightens again", "link": "https://orbitweekly.net/sky/comet?utm_id=4&lang=en"},
    ["not", "a record"],
    {"source": "Lighthouse", "title": "Fog warning", "published_at": "soon", "views": "1.5k"},
    {"source": "Lighthouse", "title": "Fog lifted", "published_at": "08-10-2023", "engagement": ""},
    {"source": "Salt &amp; Sail", "title": "<i>Regatta</i> results", "content": "Won by &#9973;",
     "published_date": "Sun, 08 Oct 2023 06:45:00 +0900", "author": "<b>Ida</b>  Moe"},
    {"source": "Lighthouse", "title": 12, "content": {"a": 1}},
    {"source": 7, "headline": "Seven", "date": 1696800000},
    {"source": "Reef Radio", "headline": "Storm", "text": "", "body": "Calm later", "published_at": "October 9, 2023 14:00 WIT"},
]
ACCEPTED = [0, 1, 3, 4, 5, 7, 8, 9, 11, 12]
DUPLICATES = [3, 5]
STORED = [i for i in ACCEPTED if i not in DUPLICATES]
REFUSED = {2: "source is required", 6: "JSON object", 10: "content: Invalid input"}
