"""Fixed values of the loop-library domain, and the dimension tables made from them.

Everything between the FIXED VALUES marks is data that results depend on: keyword dictionaries (their order breaks ties),
code tables and controlled vocabularies. One entry per line, fields separated by ``|``. Callers who bring their own
dictionary pass a DataFrame or a list of the same shape to the operators instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- FIXED VALUES ---------------------------------------------------------------------------------------------------

# keyword | category | subcategory
INSTRUMENTS = """
bass|Bass|Electric Bass
electric bass|Bass|Electric Bass
acoustic bass|Bass|Acoustic Bass
synth bass|Bass|Synthetic Bass
sub bass|Bass|Synthetic Bass
808|Bass|Synthetic Bass
drum|Drums|Drum Kit
drums|Drums|Drum Kit
beat|Drums|Electronic Beats
beats|Drums|Electronic Beats
kick|Drums|Kick
snare|Drums|Snare
hihat|Drums|Hi-hat
hi-hat|Drums|Hi-hat
hi hat|Drums|Hi-hat
cymbal|Drums|Cymbal
tom|Drums|Drum Kit
guitar|Guitars|Electric Guitar
electric guitar|Guitars|Electric Guitar
acoustic guitar|Guitars|Acoustic Guitar
slide guitar|Guitars|Slide Guitar
clean guitar|Guitars|Electric Guitar
distorted guitar|Guitars|Electric Guitar
piano|Keyboards|Piano
electric piano|Keyboards|Electric Piano
rhodes|Keyboards|Electric Piano
wurlitzer|Keyboards|Electric Piano
organ|Keyboards|Organ
clav|Keyboards|Clavinet
clavinet|Keyboards|Clavinet
keys|Keyboards|Piano
keyboard|Keyboards|Piano
synth|Keyboards|Synthesizer
synthesizer|Keyboards|Synthesizer
pad|Keyboards|Synthesizer
lead|Keyboards|Synthesizer
arp|Keyboards|Synthesizer
arpeggio|Keyboards|Synthesizer
strings|Strings|Ensemble Strings
violin|Strings|Violin
viola|Strings|Viola
cello|Strings|Cello
orchestral|Strings|Ensemble Strings
brass|Horn/Wind|Brass Section
horn|Horn/Wind|French Horn
horns|Horn/Wind|Brass Section
trumpet|Horn/Wind|Trumpet
trombone|Horn/Wind|Trombone
sax|Horn/Wind|Saxophone
saxophone|Horn/Wind|Saxophone
flute|Horn/Wind|Flute
clarinet|Horn/Wind|Clarinet
percussion|Percussion|Shaker
shaker|Percussion|Shaker
tambourine|Percussion|Tambourine
conga|Percussion|Conga
bongo|Percussion|Bongo
cowbell|Percussion|Cowbell
clap|Percussion|Clap
claps|Percussion|Clap
vibraphone|Mallets|Vibraphone
vibes|Mallets|Vibraphone
marimba|Mallets|Marimba
xylophone|Mallets|Xylophone
glockenspiel|Mallets|Glockenspiel
vocal|Vocals|Male
vocals|Vocals|Male
voice|Vocals|Male
vox|Vocals|Male
choir|Vocals|Choir
fx|Sound Effect|Motions & Transitions
effect|Sound Effect|Motions & Transitions
effects|Sound Effect|Motions & Transitions
riser|Sound Effect|Motions & Transitions
sweep|Sound Effect|Motions & Transitions
impact|Sound Effect|Motions & Transitions
hit|Sound Effect|Motions & Transitions
transition|Sound Effect|Motions & Transitions
ambient|Texture/Atmosphere|Ambient
atmosphere|Texture/Atmosphere|Ambient
texture|Texture/Atmosphere|Ambient
drone|Texture/Atmosphere|Ambient
noise|Texture/Atmosphere|Ambient
"""

# keyword | genre
GENRE_KEYWORDS = """
edm|Electronic/Dance
electronic|Electronic/Dance
house|Electronic/Dance
techno|Electronic/Dance
trance|Electronic/Dance
dubstep|Electronic/Dance
dnb|Electronic/Dance
drum and bass|Electronic/Dance
electro|Electronic/Dance
dance|Electronic/Dance
hip hop|Hip Hop
hiphop|Hip Hop
hip-hop|Hip Hop
rap|Hip Hop
trap|Hip Hop
boom bap|Hip Hop
lofi|Hip Hop
lo-fi|Hip Hop
lo fi|Hip Hop
funk|Funk
funky|Funk
disco|Funk
soul|Funk
rock|Rock/Blues
blues|Rock/Blues
metal|Rock/Blues
punk|Rock/Blues
alternative|Rock/Blues
indie|Rock/Blues
grunge|Rock/Blues
jazz|Jazz
swing|Jazz
bebop|Jazz
fusion|Jazz
country|Country/Folk
folk|Country/Folk
bluegrass|Country/Folk
americana|Country/Folk
acoustic|Country/Folk
rnb|Modern RnB
r&b|Modern RnB
neo soul|Modern RnB
urban|Urban
grime|Urban
uk garage|Urban
afrobeat|Urban
world|World/Ethnic
ethnic|World/Ethnic
latin|World/Ethnic
reggae|World/Ethnic
african|World/Ethnic
indian|World/Ethnic
asian|World/Ethnic
middle eastern|World/Ethnic
cinematic|Cinematic/New Age
film|Cinematic/New Age
movie|Cinematic/New Age
trailer|Cinematic/New Age
new age|Cinematic/New Age
chill|Cinematic/New Age
chillout|Cinematic/New Age
meditation|Cinematic/New Age
orchestral|Orchestral
classical|Orchestral
symphony|Orchestral
epic|Orchestral
experimental|Experimental
avant garde|Experimental
glitch|Experimental
idm|Experimental
"""

# keyword | descriptor
DESCRIPTOR_KEYWORDS = """
clean|Clean
dirty|Distorted
distorted|Distorted
wet|Processed
dry|Dry
acoustic|Acoustic
electric|Electric
funky|Grooving
groovy|Grooving
groove|Grooving
melodic|Melodic
melody|Melodic
harmonic|Melodic
chords|Melodic
chord|Melodic
rhythmic|Grooving
rhythm|Grooving
dark|Dark
bright|Cheerful
happy|Cheerful
sad|Dark
mellow|Relaxed
chill|Relaxed
relaxed|Relaxed
intense|Intense
aggressive|Intense
hard|Intense
soft|Relaxed
processed|Processed
effected|Processed
filtered|Processed
fill|Fill
single|Single
ensemble|Ensemble
part|Part
dissonant|Dissonant
"""

# first program | one past the last program | category | subcategory
PROGRAM_RANGES = """
0|8|Keyboards|Piano
8|16|Mallets|Vibraphone
16|24|Keyboards|Organ
24|32|Guitars|Electric Guitar
32|40|Bass|Electric Bass
40|48|Strings|Ensemble Strings
48|56|Strings|Ensemble Strings
56|64|Horn/Wind|Brass Section
64|72|Horn/Wind|Saxophone
72|80|Horn/Wind|Flute
80|88|Keyboards|Synthesizer
88|96|Keyboards|Synthesizer
96|104|Sound Effect|Motions & Transitions
104|112|World/Ethnic|Other
112|120|Percussion|Shaker
120|128|Sound Effect|Motions & Transitions
"""

# key names by number of sharps (+) or flats (-), from -7 to +7
MAJOR_KEYS = "Cb Gb Db Ab Eb Bb F C G D A E B F# C#"
MINOR_KEYS = "Ab Eb Bb F C G D A E B F# C# G# D# A#"

# names of the twelve pitch classes
NOTE_NAMES = "C C# D D# E F F# G G# A A# B"

# scale code | key type
SCALE_TYPES = """
0|neither
1|minor
2|major
3|neither
4|both
"""

# format code, trailing blanks removed | codec
CODECS = """
lpcm|Linear PCM
ima4|IMA 4:1 ADPCM
aac|AAC
alac|Apple Lossless
mp3|mp3
.mp3|MP3
ulaw|uLaw 2:1
alaw|aLaw 2:1
"""

CATEGORIES = """
Bass
Drums
Guitars
Horn/Wind
Keyboards
Mallets
Mixed
Other Instrument
Percussion
Sound Effect
Strings
Texture/Atmosphere
Vocals
"""

GENRES = """
Cinematic/New Age
Country/Folk
Electronic/Dance
Experimental
Funk
Hip Hop
Jazz
Modern RnB
Orchestral
Other Genre
Rock/Blues
Urban
World/Ethnic
"""

KEY_TYPES = """
major
minor
both
neither
"""

DESCRIPTORS = """
Acoustic
Arrhythmic
Cheerful
Clean
Dark
Dissonant
Distorted
Dry
Electric
Ensemble
Fill
Grooving
Intense
Melodic
Part
Processed
Relaxed
Single
"""

AUDIO_EXTENSIONS = "wav aif aiff mp3 m4a aac flac alac caf ogg wma".split()
MIDI_EXTENSIONS = "mid midi smf".split()
LOOP_EXTENSIONS = "caf aif aiff mid midi smf".split()

TAG_UUID = "29819273B5BF4AEFB78D62D1EF90BB2C"
MARKER_UUID = "0352811B9D5D42E1882D6AF61A6B330C"

DEFAULT_CATEGORY = "Other Instrument"
DEFAULT_SUBCATEGORY = "Other"
DEFAULT_GENRE = "Other Genre"
DEFAULT_TIME_SIGNATURE = "4/4"
DEFAULT_DURATION = 4.0
DEFAULT_TEMPO_US = 500000
DEFAULT_TICKS_PER_BEAT = 480
DEFAULT_SAMPLE_RATE = 44100.0
UNPITCHED_CATEGORIES = ["Drums", "Percussion"]

# ---- END OF FIXED VALUES --------------------------------------------------------------------------------------------


def entries(text: str) -> list[tuple[str, ...]]:
    """The lines of a fixed-value text as tuples of fields."""
    return [tuple(line.split("|")) for line in text.strip().split("\n")]


def values(text: str) -> list[str]:
    return [e[0] for e in entries(text)]


def keyword_rank(dictionary: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Dictionary entries in matching order: longest keyword first, ties in dictionary order (``sort_keywords``)."""
    return sorted(dictionary, key=lambda e: -len(e[0]))


def dim_keyword(spark: SparkSession) -> DataFrame:
    """The three built-in dictionaries as one table ``(dict, keyword, position, value1, value2)``."""
    rows = []
    for name, text in (("instrument", INSTRUMENTS), ("genre", GENRE_KEYWORDS), ("descriptor", DESCRIPTOR_KEYWORDS)):
        for position, entry in enumerate(entries(text)):
            rows.append((name, entry[0], position, entry[1], entry[2] if len(entry) > 2 else None))
    return spark.createDataFrame(rows, "dict string, keyword string, position int, value1 string, value2 string")


def dim_program(spark: SparkSession) -> DataFrame:
    rows = [(int(lo), int(hi), cat, sub) for lo, hi, cat, sub in entries(PROGRAM_RANGES)]
    return spark.createDataFrame(rows, "lo int, hi int, category string, subcategory string")


def dim_key_signature(spark: SparkSession) -> DataFrame:
    rows = []
    for mi, (names, key_type) in enumerate(((MAJOR_KEYS, "major"), (MINOR_KEYS, "minor"))):
        for i, key in enumerate(names.split()):
            rows.append((i - 7, mi, key, key_type))
    return spark.createDataFrame(rows, "sf int, mi int, key string, key_type string")


def dim_vocab(spark: SparkSession) -> DataFrame:
    """Controlled vocabularies as one table ``(kind, value)``."""
    rows = [(kind, v) for kind, text in VOCABULARIES.items() for v in values(text)]
    return spark.createDataFrame(rows, "kind string, value string")


VOCABULARIES = {"category": CATEGORIES, "genre": GENRES, "key_type": KEY_TYPES, "descriptor": DESCRIPTORS}
