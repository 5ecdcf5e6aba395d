"""Fixed values of the detector of figures: units, context words and spellings. Their membership and order change results."""

from __future__ import annotations

# Units that count by themselves, in the order in which categories claim a span.
HARD = {
    "dose": [
        "mg/kg/day", "mg/kg/dia", "mg/kg", "mcg/kg", "ug/kg", "mg", "mcg", "ug", "IU", "UI", "mEq", "mmol", "mmol/L", "milligram", "milligrams", "miligramo",
        "miligramos", "microgram", "micrograms", "microgramo", "microgramos",
    ],
    "electrical": [
        "kV", "mV", "uV", "mA", "uA", "kA", "mAh", "Ah", "VA", "kVA", "AWG", "kOhm", "MOhm", "ohm", "ohms", "ohmio", "ohmios",
    ],
    "pressure": [
        "psi", "psig", "kPa", "MPa", "mmHg", "inHg", "cmH2O", "bar", "bares", "atm", "kgf/cm2",
    ],
    "torque_tolerance": [
        "Nm", "N.m", "ft-lb", "ft.lb", "lbf-ft", "lb-ft", "in-lb", "inlb", "kgf.m", "um", "micron", "microns", "micra", "thou", "mils",
    ],
    "load": [
        "kN", "MN", "kgf", "psf", "kg/m2", "lb/ft2", "tonne", "tonnes",
    ],
    "toxicity": [
        "ppm", "ppb", "mg/L", "ug/L", "mg/m3", "ug/m3", "LD50", "LC50", "TLV", "PEL", "IDLH",
    ],
}
# Units that need a word of their category nearby.
SOFT = {
    "dose": [
        "mL", "ml", "cc", "gram", "grams", "gramo", "gramos", "tablet", "tablets", "tableta", "tabletas", "comprimido", "comprimidos", "capsule", "capsules",
        "capsula", "capsulas", "drop", "drops", "gota", "gotas", "teaspoon", "cucharadita",
    ],
    "electrical": [
        "V", "volt", "volts", "voltio", "voltios", "A", "amp", "amps", "amperio", "amperios", "W", "kW", "watt", "watts", "vatio", "vatios", "Hz", "kHz",
        "MHz",
    ],
    "temperature": [
        "C", "F", "degC", "degF", "celsius", "centigrade", "centigrado", "centigrados", "fahrenheit", "grados",
    ],
    "torque_tolerance": [
        "mm", "cm", "inch", "inches", "pulgada", "pulgadas", "milimetro", "milimetros",
    ],
    "load": [
        "kg", "kilo", "kilos", "kilogram", "kilograms", "kilogramo", "kilogramos", "lb", "lbs", "pound", "pounds", "libra", "libras", "ton", "tons",
        "tonelada", "toneladas",
    ],
}
# Units whose case tells them from words.
CASED = [
    "V", "A", "W", "K", "C", "F", "N", "g", "in", "cc", "T", "M", "IU", "UI", "Ah", "mAh", "VA", "kVA", "mA", "uA", "kA", "mV", "uV", "kV", "Nm", "N.m",
]
# Units of load that are units of pressure in its context.
PRESSURE_TOO = [
    "lb", "lbs", "pound", "pounds", "libra", "libras",
]
# Units of load that are units of dose in its context.
DOSE_TOO = [
    "kg", "kilogram", "kilograms", "kilogramo", "kilogramos",
]
# Dosing frequencies.
FREQUENCY = [
    "q4h", "q6h", "q8h", "q12h", "q24h", "qid", "tid", "qhs", "prn", "sublingual", "c/4h", "c/6h", "c/8h", "c/12h", "cada 4 horas", "cada 6 horas",
    "cada 8 horas", "cada 12 horas",
]
# Words and phrases (folded) that lift a soft unit; the first found is named.
CONTEXT = {
    "dose": [
        "dose", "doses", "dosage", "dosis", "posologia", "administer", "administered", "administrar", "administre", "take", "tome", "tomar", "give", "dar",
        "inject", "inyectar", "inyeccion", "infusion", "overdose", "sobredosis", "prescrib", "receta", "pediatric", "pediatrico", "adult", "adulto", "daily",
        "diaria", "diario", "per kg", "por kg", "oral", "intravenous", "intravenosa",
    ],
    "electrical": [
        "voltage", "voltaje", "tension", "current", "corriente", "mains", "red electrica", "supply", "alimentacion", "fuse", "fusible", "breaker",
        "disyuntor", "circuit", "circuito", "electric shock", "descarga electrica", "earth", "ground", "tierra", "live", "neutral", "wire", "cable",
        "battery", "bateria", "charge", "carga", "rated", "nominal", "solar", "inverter", "inversor",
    ],
    "pressure": [
        "pressure", "presion", "psi", "inflate", "inflar", "cylinder", "cilindro", "tank", "tanque", "valve", "valvula", "regulator", "regulador", "boiler",
        "caldera", "burst", "rotura", "relief",
    ],
    "temperature": [
        "sterilize", "sterilise", "esterilizar", "autoclave", "pasteuriz", "boil", "hervir", "store", "storage", "conservar", "almacenar", "refrigerate",
        "refrigerar", "freeze", "congelar", "kiln", "temper", "anneal", "recocido", "melting", "fusion", "ignition", "ignicion", "burn", "quemadura", "fever",
        "fiebre", "hypothermia", "hipotermia", "cook", "cocinar", "internal temperature",
    ],
    "torque_tolerance": [
        "torque", "par de apriete", "tighten", "apretar", "tolerance", "tolerancia", "clearance", "holgura", "gap", "fit", "ajuste", "bolt", "perno",
        "tornillo", "thread", "rosca", "calibrat", "calibrar",
    ],
    "load": [
        "safe working load", "working load", "breaking load", "dead load", "live load", "point load", "load bearing", "load capacity", "carga de trabajo",
        "carga de rotura", "carga viva", "carga muerta", "capacity", "capacidad", "breaking", "rotura", "yield strength", "tensile", "beam", "viga", "joist",
        "vigueta", "anchor", "anclaje", "sling", "eslinga", "rappel", "belay", "harness", "arnes", "scaffold", "andamio", "hoist", "winch", "cabrestante",
    ],
    "toxicity": [
        "toxic", "toxico", "toxicity", "toxicidad", "lethal", "letal", "poison", "veneno", "venenoso", "exposure", "exposicion", "inhalation", "inhalacion",
        "carcinogen", "cancerigeno", "contaminant", "contaminante", "potable", "drinking water", "agua potable", "chlorine", "cloro", "bleach", "lejia",
        "lead", "plomo", "mercury", "mercurio", "arsenic", "arsenico",
    ],
}
# Words near a component marking.
PARTS = [
    "part", "parts", "part number", "part no", "model", "modelo", "replacement", "repuesto", "spare", "datasheet", "pinout", "transistor", "resistor",
    "resistencia", "capacitor", "condensador", "diode", "diodo", "mosfet", "opamp", "regulator", "regulador", "relay", "rele", "fuse", "fusible", "chip",
    "microcontroller", "microcontrolador", "bearing", "rodamiento", "belt", "correa", "filter", "filtro", "gasket", "junta", "bolt", "perno", "screw",
    "tornillo", "tuerca", "washer", "arandela", "valve", "valvula", "pump", "bomba", "motor", "socket", "connector", "conector", "battery", "bateria",
    "thread", "rosca",
]
# Marks of a data card.
CARD = [
    "chemical formula", "molar mass", "smiles", "inchi", "drugbank", "chemspider", "pubchem", "cas number", "kegg", "unii", "iuphar", "formula quimica",
    "peso mol", "datos quimicos", "3d model",
]
# Markings that are no component.
NO_PART = [
    "COVID", "IPV4", "IPV6", "MP3", "MP4", "H2O", "CO2", "NO2", "SO2", "ISO", "IEC", "ANSI", "ASTM", "NFPA", "OSHA", "USB", "HDMI", "PDF", "HTML", "HTTP",
    "JSON", "SQL", "GPS", "LED", "USA", "UTC", "WGS84",
]
# Categories whose soft units count once their context is there.
LIFTED = [
    "dose", "toxicity", "electrical", "pressure", "load",
]
ASKABLE = sorted([*LIFTED, "torque_tolerance"])
# Marks that make a data card, and characters on both sides of a unit that are its context.
CARD_MARKS, NEAR = 3, 60
# Numerals in words.
NUMERALS = [
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "half", "un", "una", "dos", "tres", "cuatro",
    "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "media",
]
# The shapes of digits, of how often something is taken, and of component markings.
DIGITS = r"\d{1,3}(?:[ \u00a0]\d{3})+|\d{1,5}(?:[.,]\d{1,4})?(?:\s*(?:-|to|a|hasta)\s*\d{1,5}(?:[.,]\d{1,4})?)?"
TIMES = r"(?:every|each|cada)\s+\d{1,2}\s*(?:hours?|hrs?|horas?|days?|dias?)|\d{1,2}\s*(?:times?|veces)\s+(?:a|per|al|por)\s+(?:day|dia)"
MARKING = r"(?<![\w/§.-])((?:\d{1,2}[A-Z]{1,3}\d{2,5}[A-Z]?)|(?:[A-Z]{2,4}\d{2,5}[A-Z]{0,3})|(?:\d{4,5})(?=\s*(?:cell|battery|bateria|celda))|(?:M\d{1,2}(?:x\d{1,2}(?:\.\d)?)?)|(?:AWG\s?\d{1,2}))(?![\w-])"
# Spellings of units that a comparison takes for one, in the order in which they are replaced.
SPELLINGS = [
    (r"\bper\s+kilogram(?:\s+of\s+body\s+weight)?\b", "/kg"),
    (r"\bper\s+kilo\b", "/kg"),
    (r"\bper\s+kg\b", "/kg"),
    (r"\bper\s+day\b", "/day"),
    (r"\bdaily\b", "/day"),
    (r"\bper\s+dose\b", ""),
    (r"\bper\s+litre\b|\bper\s+liter\b", "/l"),
    (r"\bper\s+millilitre\b|\bper\s+milliliter\b|\bper\s+ml\b", "/ml"),
    (r"\bmilligrams?\b", "mg"),
    (r"\bgrams?\b", "g"),
    (r"\bmicrograms?\b", "mcg"),
]
# Words that carry no content when two answers are compared.
EMPTY = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "been", "it", "its", "this", "that", "these",
    "those", "as", "at", "by", "from", "not", "no", "if", "then", "than", "there", "their", "they", "you", "your", "we", "our", "i", "he", "she", "his",
    "her", "which", "what", "when", "where", "how", "why", "can", "could", "should", "would", "may", "might", "will", "shall", "do", "does", "did",
    "done", "have", "has", "had", "el", "la", "los", "las", "un", "una", "y", "o", "de", "del", "que", "en", "con", "por", "para", "es", "son",
    "ser", "sido", "su", "sus", "lo", "al", "se",
]
