"""Fixed values of the data model: namespaces, sentinels, word lists and lookup tables."""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

# Sentinels.
UNKNOWN = "unknown"
LIVING = "living"
NO_DATE = "0000"
NO_SUBPLACE = "(no subordinate)"
INVALID_QUERY = ("Keywords", "invalidquery")

# Main namespaces and their ids; a talk namespace's id is one more.
NAMESPACES = {
    "Article": 0, "User": 2, "Project": 4, "Image": 6, "MediaWiki": 8, "Template": 10, "Help": 12, "Category": 14, "Givenname": 100, "Surname": 102,
    "Source": 104, "Place": 106, "Person": 108, "Family": 110, "MySource": 112, "Repository": 114, "Portal": 116, "Transcript": 118,
}

# US states and the abbreviations they are known by.
US_STATES = {
    "Alabama": ("AL", "Ala",),
    "Alaska": ("AK", "Alak",),
    "Arizona": ("AZ", "Ariz",),
    "Arkansas": ("AR", "Ark",),
    "California": ("CA", "Cal", "Calif",),
    "Colorado": ("CO", "Colo", "Col",),
    "Connecticut": ("CT", "Conn",),
    "Delaware": ("DE", "Del",),
    "District of Columbia": ("DC", "D C",),
    "Florida": ("FL", "Fla",),
    "Georgia": ("GA",),
    "Hawaii": ("HI", "Haw",),
    "Idaho": ("ID", "Ida",),
    "Illinois": ("IL", "Ill",),
    "Indiana": ("IN", "Ind",),
    "Iowa": ("IA",),
    "Kansas": ("KS", "Kan",),
    "Kentucky": ("KY", "Ken",),
    "Louisiana": ("LA", "Louis",),
    "Maine": ("ME",),
    "Maryland": ("MD", "Mary",),
    "Massachusetts": ("MA", "Mass",),
    "Michigan": ("MI", "Mich",),
    "Minnesota": ("MN", "Minn",),
    "Mississippi": ("MS", "Miss",),
    "Missouri": ("MO",),
    "Montana": ("MT", "Mont",),
    "Nebraska": ("NE", "Neb",),
    "Nevada": ("NV", "Nev",),
    "New Hampshire": ("NH", "N H", "N Hamp", "N Hampshire",),
    "New Jersey": ("NJ", "N J", "N Jer", "N Jersey",),
    "New Mexico": ("NM", "N M", "N Mex", "N Mexico",),
    "New York": ("NY", "N Y", "N York",),
    "North Carolina": ("NC", "N C", "N Car", "N Carol", "N Carolina", "No Car", "No Carol", "No Carolina",),
    "North Dakota": ("ND", "N D", "N Dak", "N Dakota", "No Dak", "No Dakota",),
    "Ohio": ("OH",),
    "Oklahoma": ("OK", "Okl", "Okla",),
    "Oregon": ("OR", "Ore",),
    "Pennsylvania": ("PA", "Penn",),
    "Rhode Island": ("RI", "R I", "Rhode Is", "Rhode Isl", "R Is", "R Isl",),
    "South Carolina": ("SC", "S C", "S Car", "S Carol", "S Carolina", "So Car", "So Carol", "So Carolina",),
    "South Dakota": ("SD", "S D", "S Dak", "S Dakota", "So Dak", "So Dakota",),
    "Tennessee": ("TN", "Tenn",),
    "Texas": ("TX", "Tex",),
    "Utah": ("UT",),
    "Vermont": ("VT",),
    "Virginia": ("VA", "Vir", "Virg",),
    "Washington": ("WA", "Wash",),
    "West Virginia": ("WV", "WVa", "W V", "W Va", "W Vir", "W Virg",),
    "Wisconsin": ("WI", "Wisc", "Wis",),
    "Wyoming": ("WY", "Wyo",),
}
STATE_BY_ABBREVIATION = {a.lower(): state for state, known in US_STATES.items() for a in known}

# Spellings of months in dates, and the names that are highlighted (with one misspelling).
MONTHS = {
    "january": "01", "jan": "01", "february": "02", "febr": "02", "feb": "02", "march": "03", "mar": "03", "april": "04", "apr": "04", "may": "05",
    "june": "06", "jun": "06", "july": "07", "jul": "07", "august": "08", "aug": "08", "september": "09", "sept": "09", "sep": "09",
    "october": "10", "oct": "10", "november": "11", "nov": "11", "december": "12", "dec": "12",
}
HIGHLIGHT_MONTHS = ("january", "febuary", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

# Words of titles that stay upper case, lower case, or as a name's part.
UPPERCASE_WORDS = frozenset("I II III IV V VI VII VIII IX X".split())
LOWERCASE_WORDS = frozenset(
    """a an and at but by for from in into nor of on or over the to upon vs with against as before between during under versus within through up
    à apres après avec contre dans dès devant dévant durant de avant des du et es jusque le les par passe passé pendant pour pres près la sans suivant sur vers un une
    con depuis durante ante antes contra bajo en entre mediante para pero por sobre el o y
    aan als bij eer min na naar om op rond te ter tot uit voor
    auf gegenuber gegenüber gemäss gemass hinter neben über uber unter vor zwischen die das ein der ans aufs beim für fürs im ins vom zum am
    com net org""".split()
)
NAME_WORDS = frozenset("a à contra das de der des die du ein el en la le les o sur te ter y".split())

# Stop words of the text analyzer.
STOP_WORDS = frozenset(
    """all also amp any can from has have here its more my next our stub through time tips usage use var we web which who you your
    asp com htm html http org www display eng fhlcatalog supermainframeset titledetails titleno
    an and are as at be but by for if in into is it no not of on or s such t that the their then there these they this to was will with""".split()
)

# The name parts of places that are written out.
PLACE_ABBREVIATIONS = {"co": "county", "twp": "township", "twsp": "township", "par": "parish"}

# Letters whose romanization isn't their base letter. All other Latin letters lose their marks by rule.
ROMANIZED = {
    "æ": "ae", "ǝ": "ae", "ǽ": "ae", "ǣ": "ae", "Æ": "Ae", "Ə": "Ae", "ß": "ss", "đ": "dj", "Đ": "Dj", "ø": "oe", "œ": "oe", "Œ": "Oe", "Ø": "Oe",
    "þ": "th", "Þ": "Th", "ĳ": "y", "Ĳ": "Y", "Ƌ": "a", "ƌ": "a", "ð": "d", "Ð": "D", "Ɖ": "D", "ƒ": "f", "ſ": "f", "Ɠ": "G", "Ħ": "H", "і": "i",
    "ı": "i", "І": "I", "ј": "j", "Ј": "J", "ĸ": "K", "ł": "l", "ŀ": "l", "Ŀ": "L", "Ł": "L", "ŋ": "n", "Ŋ": "N", "ǿ": "o", "Ƿ": "P", "ƽ": "q",
    "Ƽ": "Q", "Ʀ": "R", "ŧ": "t", "Ŧ": "T", "µ": "u", "Ʊ": "U", "ȝ": "y", "Ȝ": "Y",
}


def _base_letters() -> dict[str, str]:
    """Latin letters with marks and the ASCII letters they are made of, from their decomposition."""
    out = {}
    for code in range(0xC0, 0x250):
        first = unicodedata.normalize("NFD", chr(code))[0]
        if chr(code) not in ROMANIZED and first.isascii() and first.isalpha():
            out[chr(code)] = first
    return out


ROMANIZE = _base_letters() | ROMANIZED

#: Named entities of the Latin-1 letters and signs; the no-break space is a plain space.
LATIN1_ENTITIES = {name: " " if code == 0xA0 else chr(code) for name, code in sorted(name2codepoint.items()) if 0xA0 <= code <= 0xFF}

# From a search field to the stored fields that its terms are highlighted in.
HIGHLIGHT_FIELDS = {
    "Title": "TitleStored", "User": "UserStored", "Keywords": "TextStored TitleStored",
    "PersonSurname": "FullnameStored TitleStored AltnameStored", "PersonGivenname": "FullnameStored TitleStored AltnameStored", "PersonGender": "PersonGender",
    "PersonBirthDate": "PersonBirthDateStored PersonChrDateStored", "PersonBirthYear": "PersonBirthDateStored PersonChrDateStored",
    "PersonBirthPlace": "PersonBirthPlaceStored PersonChrPlaceStored",
    "PersonDeathDate": "PersonDeathDateStored PersonBurialDateStored", "PersonDeathYear": "PersonDeathDateStored PersonBurialDateStored",
    "PersonDeathPlace": "PersonDeathPlaceStored PersonBurialPlaceStored",
    "FatherSurname": "ParentFamilyTitle", "FatherGivenname": "ParentFamilyTitle", "MotherSurname": "ParentFamilyTitle", "MotherGivenname": "ParentFamilyTitle",
    "SpouseSurname": "SpouseFamilyTitle", "SpouseGivenname": "SpouseFamilyTitle",
    "HusbandSurname": "TitleStored", "HusbandGivenname": "TitleStored", "WifeSurname": "TitleStored", "WifeGivenname": "TitleStored",
    "MarriageDate": "MarriageDateStored BannsDateStored", "MarriageYear": "MarriageDateStored BannsDateStored", "MarriagePlace": "MarriagePlaceStored BannsPlaceStored",
    "HusbandBirthDate": "HusbandBirthDateStored HusbandChrDateStored", "HusbandBirthYear": "HusbandBirthDateStored HusbandChrDateStored",
    "HusbandDeathDate": "HusbandDeathDateStored HusbandBurialDateStored", "HusbandDeathYear": "HusbandDeathDateStored HusbandBurialDateStored",
    "WifeBirthDate": "WifeBirthDateStored WifeChrDateStored", "WifeBirthYear": "WifeBirthDateStored WifeChrDateStored",
    "WifeDeathDate": "WifeDeathDateStored WifeBurialDateStored", "WifeDeathYear": "WifeDeathDateStored WifeBurialDateStored",
    "OtherSurname": "SurnameStored FullnameStored TitleStored", "OtherGivenname": "FullnameStored TitleStored", "OtherPlace": "PlaceStored TitleStored",
    "PlaceName": "TitleStored PlaceType", "LocatedInPlace": "TitleStored", "Surname": "SurnameStored FullnameStored TitleStored", "Givenname": "FullnameStored TitleStored",
    "Place": "PersonBirthPlaceStored PersonDeathPlaceStored MarriagePlaceStored PlaceStored TitleStored",
    "SourceSubject": "SourceSubjectStored", "SourceAvailability": "SourceAvailabilityStored", "Author": "AuthorStored TitleStored",
}
