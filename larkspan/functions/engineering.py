"""What a requirement text is about: scope, domains, traits, entities, attributes. Column in, Column out.

Rules are tables of patterns over the folded text (lower case, letters beyond a-z as '_'), so that word boundaries mean the
same in every engine. A ladder is a list of (value, pattern, pattern that must not match or None); the first that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOREIGN = r"[^\P{L}a-z]"

# Subjects outside the catalogue, in this order.
OUT_OF_SCOPE = (
    r"\b(?:audit|audits|auditing|taxation|chartered\s+accountan|gst\s+compliance|internal\s+audit|statutory\s+audit|earnest\s+money|emd\b|pan\s+card|bank\s+guarantee|balance\s+sheets?|financial\s+bid|turnover\s+certificate|experience\s+certificate|liquidated\s+damages|mobilization\s+advance)\b",
    r"\b(?:stationery|gel\s+pens?|ballpoint|paper\s+clips?|sticky\s+notes?|notebooks?|desk\s+organizers?|printer\s+cartridges?|toner\s+cartridges?|copier\s+paper)\b",
    r"\b(?:swivel\s+chairs?|mesh\s+chairs?|office\s+chairs?|conference\s+tables?|ergonomic\s+(?:office\s+)?chairs?|workstations?|credenza)\b",
    r"\b(?:catering|boardroom\s+hospitality|refreshments|executive\s+dining|buffet\s+meals?)\b",
    r"\b(?:seasonal\s+fruits|fresh\s+(?:fruits|vegetables)|milk\s+and\s+bakery|guest\s+house)\b",
    r"\b(?:cloud[-\s]+(?:hosted\s+)?erp|software\s+subscription|database\s+management\s+system|license\s+renewal|saas\b|kubernetes|service\s+level\s+agreement)\b",
    r"\b(?:rmqc|rail\s+mounted\s+quay\s+crane|crane\s+rail\s+track)\b",
    r"\b(?:xyz|abc\s+123|asdf|qwerty)\b",
)
# Words that say nothing technical.
GENERIC = (
    "and for the with including allied works replacement supply installation system systems dock area berth service services requirements specification specifications "
    "test testing shall standard code practice general part section clause type types method methods materials procurement work grade conforming conform "
    "repair overhaul maintenance operation at in on of to by from an as is are was were be been has have had do does did can could should would "
    "may might must new old used nos no berths tender item items etc such than or not only both all without "
    "audit audits auditing statutory compliance taxation tax taxes accountancy accounting accountant accountants chartered hiring hire firm firms consultancy consultant consultants "
    "consulting advisory legal financial finance refreshment refreshments catering amenity amenities hospitality office executive boardroom meeting meetings banquet beverage beverages "
    "appraisal governance licensing registration "
    "stationery pen pens gel ballpoint paper papers clip clips sticky notes notebook notebooks pad pads diary diaries calendar calendars desk organizer organizers stapler staplers "
    "pin pins folder folders envelope envelopes eraser erasers sharpener sharpeners marker markers highlighter highlighters glue "
    "furniture chair chairs swivel sofa sofas table tables workstation workstations ergonomic almirah cupboard cabinet cabinets credenza credenzas "
    "enterprise hosted platform monthly annual percent agreement provisioning"
).split()
# Nouns that are always in scope.
CORE = "valve valves pump pumps cable cables pipe pipes transformer transformers motor motors switchgear panel panels rebar steel cement conductor conductors wire wires engine engines gear textile textiles".split()
# Signs of an administrative clause, products that overrule them, and wording that leaves a choice open.
ADMINISTRATIVE = "earnest money deposit|emd|security deposit|payment terms|submission deadline|tender fee|arbitration clause|penalty clause|force majeure|bid validity|turnover criteria|gst registration|pan card|experience certificate|terms of payment|liquidated damages|jurisdiction of court|validity of tender"
PRODUCTS = "pipe|valve|cable|transformer|pump|cement|steel|motor|switchgear|concrete|paint|luminaire|panel|compressor"
DISCRETION = r"\b(?:as directed by|at the discretion of|directed by\s+(?:the\s+)?site|as per\s+(?:the\s+)?site in[- ]charge|as directed by\s+(?:the\s+)?(?:site\s+in[- ]charge|engineer))\b"
# Keywords of the domains; those of several words count anywhere, single words as words.
DOMAINS = {
    "CRANES_AND_RAIL": "crane,cranes,rail,rails,track,tracks,rmqc,quay,gantry,hoist,hoists,trolley,locomotive,rolling stock,wagon,berth crane,container crane,derrick",
    "VALVES_AND_FLOW": "valve,valves,gate valve,sluice valve,globe valve,check valve,ball valve,butterfly valve,plug valve,cock,bonnet,bolted bonnet,flow control,flanged valve",
    "PIPES_AND_FITTINGS": "pipe,pipes,piping,fitting,fittings,tube,tubes,cpvc,upvc,pvc pipe,pvc pipes,pvc fitting,pvc fittings,pvc conduit,hdpe,ductile iron,cast iron pipe,gi pipe,plumbing,water supply,potable water distribution,drainage,sewerage pipe",
    "ELECTRICAL_AND_POWER": "cable,cables,conductor,conductors,wire,wires,transformer,switchgear,vfd,motor,inverter,electrical machine,electrical machines,rotating electrical machines,rotating machine,electric motor,induction motor,generator,substation,circuit breaker,panel,voltage,1.1 kv,3.3 kv,11 kv,33 kv,ht cable,lt cable,power distribution",
    "PUMPS_AND_ROTATING": "pump,pumps,pumping,submersible,slurry pump,centrifugal pump,impeller,sump pump,water pump,dewatering",
    "CIVIL_AND_STRUCTURAL": "structural steel,truss,trusses,girder,rebar,cement,concrete,rcc,tile,tiles,ceramic tile,masonry,brick,asphalt,roofing,bituminous,flooring",
    "FOOD_AND_AGRICULTURE": "food,dairy,milk,grain,agriculture,agricultural,pesticide,irrigation,agro,hygiene,haccp,canteen,catering",
    "FIRE_SAFETY": "fire extinguisher,sprinkler,fire hydrant,fire alarm,smoke detector,fire fighting,fire hose",
    "THERMAL_INSULATION": "insulation,thermal insulation,mineral wool,calcium silicate,lagging,refractory",
    "AEROSPACE_AND_DEFENSE": "aerospace,aircraft,fuselage,avionics,supersonic,spacecraft,satellite,prepreg,flight,rocket",
}
SUBMERSIBLE = r"\b(?:submersible|borewell|bore\s*well|borehole|tube\s*well|tubewell|openwell|submerged)\b"
# Ladders of the traits.
TRAITS = {
    "service_fluid": (
        ("potable_water", "potable|drinking water|hot and cold water|domestic water|aqueous|hydrous|water supply", None),
        ("fire_extinguishing", "sprinkler|fire extinguishing|fire fighting|fire protection|wet pipe|deluge", None),
        ("drainage_sewerage", "drainage|sewerage|sewer|waste water", None),
        ("industrial_chemical", "chemical|corrosive|effluent|refinery|acid", None),
    ),
    "operating_medium": (
        ("subsea", "subsea|deep ocean|umbilical", None),
        ("marine", "shipboard|marine|shipbuilding|naval|for ships|in ships", None),
        ("aircraft", "aircraft|aviation|aerospace|fuselage|avionics", None),
        ("underground", "underground|buried|trench|direct burial", None),
        ("overhead", "overhead|aerial", None),
    ),
    "voltage_tier": (
        ("mv_ht", r"\b(?:11\s*kv|33\s*kv|3\.3\s*kv|6\.6\s*kv|22\s*kv|66\s*kv|ht\s+cable|medium\s+voltage|high\s+voltage)\b", None),
        ("lv_lt", r"\b(?:1\.1\s*kv|1100\s*v|415\s*v|lt\s+cable|low\s+voltage)\b", None),
    ),
    "steel_grade_process": (
        ("tmt_deformed", r"\b(?:fe\s*500d?|fe\s*415|fe\s*550d?|fe\s*600|tmt|thermo\s*mechanically\s*(?:treated|processed)|high\s+strength\s+deformed|deformed\s+(?:steel\s+)?bar|ctd|surface\s+ribs|ribbed\s+bars?)\b", None),
        ("mild_steel", r"\b(?:mild\s+steel|fe\s*250|plain\s+round)\b", "deformed"),
    ),
    "pump_installation": (
        ("surface_coupled", r"\b(?:non[-\s]+submersible|not\s+submersible)\b", None),
        ("surface_coupled", r"\b(?:surface\s+pump|surface\s+coupled|end\s+suction|horizontal\s+split|process\s+(?:water\s+)?pump|coupled\s+with|coupled\s+to)\b", SUBMERSIBLE),
        ("submersible_borewell", r"\b(?:borewell|bore\s*well|borehole|tube\s*well|tubewell)\b", None),
        ("openwell", "openwell", None),
        ("submersible", "submersible|" + SUBMERSIBLE, None),
    ),
    "service_phase": (
        ("steam", r"\bsteam\b", None),
        ("liquid_water", r"\b(?:potable|drinking\s+water|water\s+supply|hot\s+and\s+cold\s+water)\b", None),
        ("slurry", r"\b(?:slurry|sludge)\b", None),
    ),
    "pressure_rating_mode": (
        ("non_pressure_gravity", r"\b(?:non[-\s]*pressure|gravity\s+(?:sewer|flow|drainage))\b", None),
        ("pressurized", r"\b(?:pressure\s+main|pumping\s+main|pressurized)\b", None),
    ),
    "chemical_nature": (
        ("aggressive_chemical", r"\b(?:sul(?:ph|f)uric\s*acid|hydrochloric\s*acid|nitric\s*acid|concentrated\s*acid|caustic|acidic\s*effluent|chemical\s*slurry)\b", None),
        ("clean_water", r"\b(?:clean(?:\s*,?\s*cold)?\s*water|clear(?:\s*,?\s*cold)?\s*water|potable\s*water|drinking\s*water)\b", None),
    ),
    "duty_traffic": (
        ("heavy_industrial_traffic", r"\b(?:heavy\s*(?:industrial\s*)?traffic|forklift|heavy\s*vehicular|crane\s*track)\b", None),
        ("architectural_wall", r"\b(?:wall\s*tiles?|wall\s*finishes?|vertical\s*cladding|wall\s*only)\b", None),
    ),
    "product_category": (("chemical_cleaner", r"\b(?:cleaning\s+(?:acidic\s+)?solvent|solvent\s+compound|cleaning\s+agent|cleaning\s+compound|degreaser|descaling\s+compound)\b", None),),
}
PRESSURE = r"\b([0-9]+(?:\.[0-9]+)?)\s*(?:bar|kg/cm2|mpa)\b"
TEMPERATURE = r"\b([0-9]+(?:\.[0-9]+)?)\s*(?:°\s*c|c\b|deg\s*c|degrees?\s*(?:c|celsius))\b"
# Entities and their types, in the order in which they are looked for.
ENTITIES = (
    ("control", r"\b(vfd|variable\s+frequency\s+drive|variable\s+speed\s+drive|adjustable\s+speed\s+drive|ac\s+drive|inverter\s+drive|soft\s+starter)\b"),
    ("equipment", r"\b(distribution\s+transformers?|power\s+transformers?|oil\s+immersed\s+transformers?|step[-\s]*down\s+transformers?|transformers?)\b"),
    ("electrical", r"\b(distribution\s+pillars?|lt\s+(?:cable\s+)?distribution\s+pillars?|feeder\s+pillars?|control\s+panel|starter\s+panel|distribution\s+boards?|sub-distribution\s+board|switchgear|controlgear|mccb|mcb|dbo|panel)\b"),
    ("electrical", r"\b(induction\s+motors?|submersible\s+motors?|electric\s+motors?|rotating\s+electrical\s+machines?|motors?)\b"),
    ("material", r"\b(underground\s+power\s+cables?|underground\s+cables?|power\s+cables?|xlpe\s+cables?|pvc\s+insulated\s+cables?|armoured\s+cables?|cables?|wiring|conductor|bus\s+trunking)\b"),
    ("equipment", r"\b(copper\s+earthing\s+stations?|earthing\s+stations?|neutral\s+earthing|earthing|earth\s+electrode|copper\s+earthing|surge\s+arresters?)\b"),
    ("equipment", r"\b(immersion\s+heater(?:\s+elements?)?|heating\s+elements?|oil\s+immersion\s+heaters?|electric\s+immersion\s+heaters?|immersion\s+heaters?)\b"),
    ("equipment", r"\b(sports\s+lighting|floodlights?|luminaires?|light\s+fittings?|defective\s+lights?|led\s+lights?)\b"),
    ("product", r"\b(process\s+water\s+pumps?|centrifugal\s+pumps?|submersible\s+pumps?|booster\s+pumps?|slurry\s+pumps?|water\s+pumps?|pumps?)\b"),
    ("product", r"\b(sluice\s+valves?|gate\s+valves?|globe\s+valves?|check\s+valves?|non-return\s+valves?|butterfly\s+valves?|ball\s+valves?|air\s+valves?|pressure\s+relief\s+valves?|bib\s+taps?|stop\s+valves?|valves?)\b"),
    ("material", r"\b(steel\s+pipe\s+flanges?|flanges?|jointing\s+sheets?|asbestos\s+fiber\s+sheets?|gaskets?|flange\s+joints?)\b"),
    ("material", r"\b(thermal\s+insulation|mineral\s+wool|bonded\s+mineral\s+wool|glass\s+wool|insulation\s+work|insulation)\b"),
    ("material", r"\b(thermo[-\s]*mechanically\s+(?:treated|processed)(?:\s+ferrous)?(?:\s+cylindrical)?(?:\s+rods?|\s+bars?)?|high\s+strength\s+deformed\s+(?:steel\s+)?bars?|tmt\s+(?:steel\s+)?bars?|deformed\s+steel\s+bars?|surface\s+ribs|rebar|reinforcement\s+bars?|steel\s+reinforcement)\b"),
    ("equipment", r"\b(structural\s+steel\s+(?:roof\s+)?truss(?:es)?|roof\s+truss(?:es)?|steel\s+truss(?:es)?|truss(?:es)?|tubular\s+purlins?|steel\s+purlins?|purlins?|structural\s+steelwork|gantry\s+girders?|portal\s+frames?|structural\s+steel\s+sections?)\b"),
    ("material", r"\b(post[-\s]*chlorinated\s+vinyl(?:\s+synthetic)?\s+polymers?|chlorinated\s+polyvinyl\s+chloride(?:\s+pipes?)?|cpvc\s+pipes?|fluid\s+conveyance\s+conduits?|aqueous\s+hydrous\s+fluid\s+conveyance\s+conduits?|conduits?|hubless\s+pipes?|cast\s+iron\s+pipes?|gi\s+pipes?|galvanized\s+iron\s+pipes?|plastic\s+(?:water\s+supply\s+)?pipes?|plastic\s+piping|upvc\s+pipes?|pvc\s+pipes?|hdpe\s+pipes?|precast\s+concrete\s+pipes?|rcc\s+pipes?|polyethylene\s+pipes?|mild\s+steel\s+pipes?|steel\s+tubes?|sewerage\s+pipelines?|sewerage\s+pipes?|pipelines?|pipes?)\b"),
    ("product", r"\b(sanitary\s+fittings?|vitreous\s+china|vitreous\s+sanitary\s+appliances?|wash\s+basins?|water\s+closets?|urinals?|flushing\s+cisterns?)\b"),
    ("material", r"\b(ceramic\s+tiles?|vitrified\s+tiles?|glazed\s+tiles?|wall\s+tiles?|floor\s+tiles?|pressed\s+ceramic\s+tiles?|tiles?)\b"),
    ("material", r"\b(cement\s+plaster|plaster\s+repairing|plastering|ordinary\s+portland\s+cement|opc|cement|concrete)\b"),
    ("material", r"\b(upvc\s+profiles?|upvc\s+partition\s+wall|partition\s+walls?)\b"),
    ("application", r"\b(potable\s+water\s+supply|potable\s+water|drinking\s+water|water\s+supply)\b"),
    ("application", r"\b(sewerage\s+pipeline|sewerage|waste\s+water|drainage|industrial\s+effluent|effluent)\b"),
    ("application", r"\b(food\s+hygiene|food\s+safety|food\s+outlet|canteen|cafeteria|catering|haccp|food\s+premises)\b"),
    ("application", r"\b(food\s+storage\s+depot|fsd|warehouse|stadium|sports\s+stadium|laboratory|cleanroom|stp|sewage\s+treatment\s+plant|hospital)\b"),
    ("installation", r"\b(sitc|supply,\s+installation,\s+testing\s+and\s+commissioning|commissioning|laying\s+of|laying\s+underground|laying|erection|cable\s+laying|trenching|excavation|dismantling|shifting|reinstallation|replacement|replacing|repairing|repairs?|maint|maintenance|overhaul|renovation|upgradation)\b"),
    ("testing", r"\b(testing|hydrostatic\s+test|pressure\s+test|dielectric\s+test|insulation\s+resistance|inspection)\b"),
)
# Materials by their names, first that fits.
MATERIALS = (
    ("xlpe", r"\b(?:xlpe|cross linked polyethylene|cross-linked polyethylene|crosslinked polyethylene)\b", None),
    ("cpvc", r"\b(?:cpvc|chlorinated polyvinyl chloride|post-chlorinated|post chlorinated|chlorinated vinyl)\b", None),
    ("upvc", r"\b(?:upvc|unplasticized pvc|unplasticized polyvinyl chloride|pvc-u)\b", None),
    ("pvc", r"\b(?:pvc|polyvinyl chloride)\b", None),
    ("hdpe", r"\b(?:hdpe|high density polyethylene)\b", None),
    ("ductile iron", r"\b(?:di|ductile iron|spheroidal graphite iron)\b", None),
    ("cast iron", r"\b(?:ci|cast iron|sluice)\b", None),
    ("mild steel", r"\b(?:ms|mild steel)\b", None),
    ("stainless steel", r"\b(?:ss|stainless steel)\b", None),
    ("steel", r"\b(?:steel|carbon steel|cast steel|forged steel)\b", None),
    ("brass", r"\bbrass\b", None),
    ("gunmetal", r"\b(?:gunmetal|leaded tin bronze)\b", None),
    ("galvanized iron", r"\b(?:gi|galvanized iron|galvanised iron)\b", None),
    ("aluminium", r"\b(?:aluminium|aluminum)\b", None),
    ("copper", r"\bcopper\b", None),
    ("vitreous china", r"\b(?:vitreous china|vitreous sanitary)\b", None),
    ("elastomeric", r"\b(?:elastomer|rubber|epdm|nitrile|neoprene)\b", None),
    ("concrete", r"\b(?:concrete|rcc|pcc)\b", None),
)
# Ladders of further attributes.
ATTRIBUTES = {
    "pump_type": (("submersible", "submersible", None), ("centrifugal", "centrifugal", None)),
    "valve_type": (("gate", "gate|sluice", None), ("butterfly", "butterfly", None), ("check", "check|non-return", None), ("globe", "globe", None), ("ball", "ball", None), ("air", "air.*valve|valve.*air", None)),
    "phase": (("3-phase", "3 phase|three phase|three-phase", None), ("1-phase", "1 phase|single phase|single-phase", None)),
    "grade": (("OPC", "opc|ordinary portland", None), ("PPC", "ppc|pozzolana portland", None), ("PSC", "psc|slag cement", None)),
}
# Numbers of product standards and of codes of practice.
PRODUCT_NUMBERS = r"\b(?:7098|694|1554|458|14333|15778|4984|4985|1239|3589|8329|778|14846|10434|10611|269|1489|15622|13712|1180|2026|800|801|808|2062|61439|61800|60034|325|12615|5120|9694|16088|15905|5039|9079|1520|6595)\b"
CODE_NUMBERS = r"\b(?:1255|783|732|1661|14164|3043|SP 30|SP 57)\b"
FACILITIES = "food hygiene|sanitary and hygienic requirements|national electrical code|code of practice for electrical wiring installations|code of practice for construction of|guidelines for establishment|food safety management systems|haccp"
# Ladder of the roles that a title tells, below those of the numbers.
TITLE_ROLES = (
    ("TEST_METHOD", "method of test|methods of test|test method|methods for test|sampling and test", None),
    ("SAFETY_STANDARD", "safety requirements|code of safety|safety code|fire safety", None),
    ("TERMINOLOGY_STANDARD", "glossary of terms|terminology|vocabulary|symbols", None),
)
# Words that short names stand for.
ACRONYMS = {"pvc": ["polyvinyl", "chloride"], "xlpe": ["crosslinked", "polyethylene"], "hdpe": ["polyethylene"], "cpvc": ["chlorinated", "polyvinyl"], "upvc": ["unplasticized"], "haccp": ["hazard", "analysis"], "opc": ["ordinary", "portland"], "ppc": ["portland", "pozzolana"]}
# Role and status of a dependency by the type of its relationship, and the words that make it applicable.
DEPENDENCIES = (
    ("TEST_METHOD", "testing", "TEST_DEPENDENCY", "test|sampling|inspection|quality|hydrostatic"),
    ("INSTALLATION_CODE", "installation", "INSTALLATION_CODE", None),
    ("INSTALLATION_STANDARD", "installation", "INSTALLATION_CODE", "laying|fixing|installation|jointing|erection|construction|civil works"),
    ("CODE_OF_PRACTICE", "installation", "INSTALLATION_CODE", "laying|fixing|installation|jointing|erection|construction|civil works"),
    ("CODE_OF_PRACTICE_FOR", "installation", "INSTALLATION_CODE", "laying|fixing|installation|jointing|erection|construction|civil works"),
    ("NORMATIVE_REFERENCE", "normative", "NORMATIVE_DEPENDENCY", ""),
    ("REFERENCES", "normative", "NORMATIVE_DEPENDENCY", ""),
    ("SAFETY_STANDARD", "safety", "SAFETY_DEPENDENCY", "safety|hazard|protection|flameproof|fire|shock"),
    ("TERMINOLOGY_STANDARD", "terminology", "TERMINOLOGY_DEPENDENCY", None),
    ("ALLIED_STANDARD", "allied", "ALLIED_DEPENDENCY", None),
    ("IDENTICAL_ADOPTION", "allied", "ALLIED_DEPENDENCY", None),
    ("CERTIFICATION_RELATED", "certification", "CERTIFICATION_DEPENDENCY", None),
    ("QCO_RELATED", "certification", "QCO_DEPENDENCY", None),
    ("SUPERSEDES", "lifecycle", "RELATED_FOR_REVIEW", None),
    ("SUPERSEDED_BY", "lifecycle", "RELATED_FOR_REVIEW", None),
    ("AMENDS", "lifecycle", "AMENDMENT_DEPENDENCY", None),
)


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), FOREIGN, "_")


def ladder(f: Column, steps, default: str | None = None) -> Column:
    """The value of the first step that fits the folded text f."""
    out = None
    for value, must, never in steps:
        fits = f.rlike(must) & ~f.rlike(never) if never else f.rlike(must)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(F.lit(default))


def scope_rule(f: Column) -> Column:
    """0 for an empty text, 1 to 8 by OUT_OF_SCOPE, 9 for too few telling words, null for a text in scope."""
    words = F.regexp_extract_all(f, F.lit(r"\b[a-z]{3,}\b"), F.lit(0))
    few = F.size(F.filter(words, lambda w: ~w.isin(GENERIC))) < 2
    out = F.when(F.trim(f) == "", 0)
    for n, p in enumerate(OUT_OF_SCOPE, 1):
        out = out.when(f.rlike(p), n)
    return out.when(F.arrays_overlap(words, F.array(*map(F.lit, CORE))), F.lit(None)).when(few & ~f.rlike(r"\bis\s*[0-9]+"), 9)


def is_administrative(f: Column) -> Column:
    return f.rlike(ADMINISTRATIVE) & ~f.rlike(PRODUCTS)


def domain_pattern(keywords: str) -> str:
    """One pattern for a domain's keywords. Its phrases hold no character that means more than itself but the dot."""
    words = [w.replace(".", r"\.") for w in keywords.split(",")]
    return rf"\b(?:{'|'.join(w for w in words if ' ' not in w)})\b" + "".join("|" + w for w in words if " " in w)


def domains(f: Column) -> Column:
    return F.array_compact(F.array(*[F.when(f.rlike(domain_pattern(k)), d) for d, k in DOMAINS.items()]))


def profile(f: Column) -> dict[str, Column]:
    """Traits by name; null where nothing tells."""
    out = {k: ladder(f, steps) for k, steps in TRAITS.items()}
    pressure = F.regexp_extract(f, PRESSURE, 1)
    out["pressure_rating_mode"] = F.coalesce(out["pressure_rating_mode"], F.when((pressure != "") & (F.expr("try_cast(0 as double)") < F.when(pressure != "", pressure).cast("double") - 1), "pressurized"))
    degrees = F.regexp_extract(f, TEMPERATURE, 1)
    out["operating_temperature_c"] = F.when(degrees != "", degrees).cast("double")
    return out


def entities(f: Column) -> Column:
    """Entities as struct(pos, i, kind, text), by place of first occurrence. One that is part of an earlier found one is
    left out, and so is one that is part of another of its kind."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(f, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))

    every = F.flatten(F.array(*[found(k, p) for k, p in ENTITIES]))

    def placed(xs: Column) -> Column:
        new = F.filter(F.transform(xs, lambda x, i: F.struct(F.instr(f, x["text"]).alias("pos"), i.alias("i"), x["kind"].alias("kind"), x["text"].alias("text"))), lambda x: ~F.exists(xs, lambda y: y["text"].contains(x["text"]) & (F.array_position(xs, y) <= x["i"])))
        return F.transform(F.array(new), lambda ys: F.array_sort(F.filter(ys, lambda x: ~F.exists(ys, lambda y: (y["text"] != x["text"]) & y["text"].contains(x["text"]) & (y["kind"] == x["kind"])))))[0]

    return F.transform(F.array(F.array_distinct(every)), placed)[0]


def confidence(kinds: Column) -> Column:
    core = F.arrays_overlap(kinds, F.array(*map(F.lit, ["material", "product", "equipment", "electrical", "control"])))
    return F.when(core & F.array_contains(kinds, "application"), 1.0).when(core, 0.9).when(F.size(kinds) > 0, 0.7).otherwise(0.3)


def standard_role(number: Column, title: Column) -> Column:
    """What a standard is for, by its number first, then by its title (lower case)."""
    code = F.upper(number).rlike(CODE_NUMBERS)
    practice = title.contains("code of practice") | code | title.contains("haccp") | title.contains("guidelines")
    appliance = title.rlike("food grinding machines|kitchen machines|electric food mixer|portable electric tools|hand-held electric tools|similar electrical appliances|household.*(?:safety|appliances)|(?:safety|appliances).*household")
    out = F.when(F.upper(number).rlike(PRODUCT_NUMBERS) & ~code, "PRIMARY_PRODUCT").when(appliance, "APPLIANCE_TOOL")
    out = out.when(title.rlike(FACILITIES) & (title.contains("code of practice") | title.contains("haccp") | code), "FACILITY_PREMISE")
    return out.when(practice | title.rlike("installation and maintenance|installation of|laying of"), "INSTALLATION_CODE").otherwise(ladder(title, TITLE_ROLES, "PRIMARY_PRODUCT"))


def expanded(words: Column) -> Column:
    """words with what the acronyms among them stand for behind."""
    more = F.create_map(*[x for k, v in ACRONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = F.filter(words, lambda w: F.map_contains_key(more, w))
    return F.concat(words, F.flatten(F.transform(known, lambda w: F.element_at(more, w))))


def clause_hint(t: Column) -> Column:
    """The clause that a text names: a number, a table or a named section; null if none."""
    found = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    table = found(r"(?i)\bTable\s+([0-9]+(?:\.[0-9]+)*)\b")
    return F.coalesce(found(r"(?i)\b(?:Clause|Section|Cl\.)\s*([0-9]+(?:\.[0-9]+)*)\b"), F.concat(F.lit("Table "), table), F.initcap(found(r"(?i)\b(Foreword|Scope)\b")))


def standard_tokens(t: Column) -> Column:
    """Numbers of standards in a text, upper case, single spaces."""
    found = F.regexp_extract_all(t, F.lit(r"(?i)\b((?:IS/ISO|IS/IEC|IS|SP)\s*/?\s*[0-9]+(?:\s*(?:Part|Sec)\s*[0-9]+)*(?:\s*\(Part\s*[0-9]+\))?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(F.upper(F.regexp_replace(F.trim(x), r"\s+", " ")), F.lit(" / "), F.lit("/")))


def sector(category: Column) -> Column:
    """The provisional sector of a category."""
    c = F.lower(category)
    named = F.when(c.contains("civil"), "CIVIL_WORKS").when(c.contains("elect"), "ELECTRICAL").when(c.contains("mech"), "MECHANICAL").when(c.rlike("cater|hotel|food"), "CATERING")
    return F.concat(F.lit("PROVISIONAL:"), F.coalesce(named, F.upper(F.regexp_replace(c, "[^a-z0-9]", "_"))))


def cohort(c: dict[str, Column]) -> Column:
    """The calibration cohort of a case, of the columns id, expected, standard, kind, reasoning and title."""
    negative = c["expected"].isin("REJECT_INELIGIBLE", "NEGATIVE_CONTROL") | c["id"].rlike("NEG-00[145]")
    vague = (c["expected"] == "ABSTAIN_UNDER_SPECIFIED") | c["id"].contains("NEG-003") | ((c["standard"] == "") & (c["expected"] != "RECOMMEND"))
    steps = (
        ((c["kind"] == "DISTRACTOR_PROBE") | c["id"].contains("NEG-002"), "RETRIEVAL_DISTRACTOR_PROBE"),
        (negative, "OPEN_SET_INELIGIBLE"),
        (vague, "UNDER_SPECIFIED"),
        (F.lower(c["reasoning"]).contains("competing") | F.lower(c["title"]).contains("multiple competing"), "AMBIGUOUS_COMPETING"),
        (c["standard"].contains(";"), "ANSWERABLE_IN_DOMAIN_COMPOUND"),
        (c["standard"].rlike("IS 15622|IS 15000 : 2024|IS 732 : 2019|IS 3043 : 2018"), "LIFECYCLE_EDITION_SENSITIVE"),
    )
    return F.coalesce(*[F.when(cond, name) for cond, name in steps], F.lit("ANSWERABLE_IN_DOMAIN_SINGLE"))


def dependency(kind: Column, f: Column) -> tuple[Column, Column, Column]:
    """Role and status of a dependency, and whether the requirement's text makes it applicable."""
    role, status, applies = F.lit("other"), F.lit("RELATED_FOR_REVIEW"), F.lit("REVIEW_REQUIRED")
    for name, r, s, words in reversed(DEPENDENCIES):
        role, status = F.when(kind == name, r).otherwise(role), F.when(kind == name, s).otherwise(status)
        if words is not None:
            applies = F.when((kind == name) & f.rlike(words or ".*"), "APPLICABLE").otherwise(applies)
    return role, status, applies
