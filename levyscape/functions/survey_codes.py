"""The survey code books, stated as data.

Everything in this module is a fixed value: codes, labels, level orders and
indicator names that results have to carry unchanged.
"""

from __future__ import annotations

from levyscape.functions.codebook import CategorySpec, spread

# --- fixed values: code -> label -------------------------------------------------
PROVINCE = {
    1: "Western Cape",
    2: "Eastern Cape",
    3: "Northern Cape",
    4: "Free State",
    5: "KwaZulu-Natal",
    6: "North West",
    7: "Gauteng",
    8: "Mpumalanga",
    9: "Limpopo",
}
URBAN = {1: "Urban formal", 2: "Urban informal", 4: "Traditional area", 5: "Rural formal"}
GENDER = {1: "Male", 2: "Female"}
ETHNICITY = {1: "African Black", 2: "Coloured", 3: "Indian/Asian", 4: "White"}
EDUCATION = spread(
    {
        "Pre-primary Education": [1],
        "Primary Education": range(2, 6),
        "Lower Secondary Education": range(6, 9),
        "Upper Secondary Education": range(9, 15),
        "Post-secondary Non-tertiary Education": range(15, 25),
        "Short-cycle Tertiary Education": range(25, 27),
        "Bachelors or Equivalent": range(27, 30),
        "Masters or Equivalent": [30],
        "No Schooling": [98],
    }
)
OWNERSHIP = {1: "Ownership", 3: "No Access"}
FREE_ELECTRICITY = {1: "Free Electricity", 2: "No Free Electricity"}
# Fuel codes as the driver models name them.
MODEL_LIGHTING = {
    1: "Electricity Mains",
    2: "Electricity Other",
    4: "Paraffin",
    7: "Candles",
    9: "Solar Energy",
}
MODEL_FUEL = {
    1: "Mains",
    2: "Electricity Other",
    3: "Gas",
    4: "Paraffin",
    5: "Wood",
    6: "Coal",
    8: "Animal Dung",
    9: "Solar Energy",
    11: "No Access",
}
# Fuel codes as the energy-mix tables name them; 10 and 11 differ by survey.
MIX_FUEL = {
    1: "Electricity Mains",
    2: "Other Electricity",
    3: "Gas",
    4: "Paraffin",
    5: "Wood",
    6: "Coal",
    8: "Animal Dung",
    9: "Solar Energy",
}
MIX_LIGHTING = {
    1: "Electricity Mains",
    2: "Other Electricity",
    3: "Gas",
    4: "Paraffin",
    7: "Candles",
    9: "Solar Energy",
}
ACCESS = {1: "Access", 2: "No Access"}
SOURCE_A = {1: "Other", 2: "Other", 3: "Generator", 4: "Solar Energy", 6: "Other"}
SOURCE_C = {1: "Other", 2: "Other", 3: "Other", 4: "Other", 5: "Generator", 6: "Solar Energy", 7: "Other"}

# --- fixed values: level orders --------------------------------------------------
PROVINCE_LEVELS = tuple(PROVINCE.values())
EDUCATION_LEVELS = (
    "Upper Secondary Education",
    "No Schooling",
    "Pre-primary Education",
    "Primary Education",
    "Lower Secondary Education",
    "Post-secondary Non-tertiary Education",
    "Short-cycle Tertiary Education",
    "Bachelors or Equivalent",
    "Masters or Equivalent",
    "Other",
)
OWNERSHIP_LEVELS = ("Ownership", "No Access", "Other")
ELECTRICITY_LEVELS = ("Mains", "Solar Energy", "No Access", "Other")
FREE_LEVELS = ("No Free Electricity", "Free Electricity", "Other")
LIGHTING_LEVELS = ("Electricity Mains", "Electricity Other", "Paraffin", "Candles", "Solar Energy", "Other")
FUEL_LEVELS = (
    "Mains",
    "Electricity Other",
    "Gas",
    "Paraffin",
    "Coal",
    "Wood",
    "Animal Dung",
    "Solar Energy",
    "No Access",
    "Other",
)
ACCESS_LEVELS = ("No Access", "Access")
SOURCE_LEVELS = ("Generator", "Solar Energy", "Other", "Mains")
MIX_COOKING_LEVELS = (
    "Other",
    "Solar Energy",
    "Paraffin",
    "Animal Dung",
    "Gas",
    "Coal",
    "Wood",
    "Other Electricity",
    "Electricity Mains",
)
MIX_LIGHTING_LEVELS = (
    "Other",
    "Solar Energy",
    "Candles",
    "Paraffin",
    "Gas",
    "Other Electricity",
    "Electricity Mains",
)
MIX_HEATING_LEVELS = ("No Access", *MIX_COOKING_LEVELS)

# --- predictors of the driver models --------------------------------------------
MODEL_SPECS = (
    CategorySpec("province", PROVINCE, PROVINCE_LEVELS),
    CategorySpec("urban_1", URBAN, tuple(URBAN.values())),
    CategorySpec("gender_hhh", GENDER, tuple(GENDER.values())),
    CategorySpec("ethnicity_hhh", ETHNICITY, tuple(ETHNICITY.values())),
    CategorySpec("education_hhh", EDUCATION, EDUCATION_LEVELS, "Other"),
    CategorySpec("own_vehicle", OWNERSHIP, OWNERSHIP_LEVELS, "Other"),
    CategorySpec("own_stove", OWNERSHIP, OWNERSHIP_LEVELS, "Other"),
    CategorySpec("electricityfree", FREE_ELECTRICITY, FREE_LEVELS, "Other"),
    CategorySpec("lightingsource", MODEL_LIGHTING, LIGHTING_LEVELS, "Other"),
    CategorySpec("cookingsource", MODEL_FUEL, FUEL_LEVELS, "Other"),
    CategorySpec("heatingsourcewater", MODEL_FUEL, FUEL_LEVELS, "Other"),
    CategorySpec("heatingsourcespace", MODEL_FUEL, FUEL_LEVELS, "Other"),
)
# Order in which the models list their factors (electricity source is derived).
MODEL_FACTORS = (
    "province",
    "urban_1",
    "gender_hhh",
    "ethnicity_hhh",
    "education_hhh",
    "own_vehicle",
    "own_stove",
    "electricitysource",
    "electricityfree",
    "lightingsource",
    "cookingsource",
    "heatingsourcewater",
    "heatingsourcespace",
)
TRANSFER_FACTORS = ("electricitymains", "province", "urban_1", "ethnicity_hhh", "gender_hhh")
TRANSFER_MAINS_LEVELS = ("Mains", "Other")


# --- energy-mix attributes of survey A and survey C ------------------------------
def _mix(survey: str) -> dict[str, CategorySpec]:
    a = survey == "A"
    other, none = (10, 11) if a else (11, 10)
    heating = {**MIX_FUEL, other: "Other", none: "No Access"}
    return {
        "electricitycon": CategorySpec("electricitycon", ACCESS, ACCESS_LEVELS, drop=(9,)),
        "electricitysource": CategorySpec(
            "electricitysource", SOURCE_A if a else SOURCE_C, SOURCE_LEVELS, drop_unlisted=True
        ),
        "cookingsource": CategorySpec(
            "cookingsource",
            {**MIX_FUEL, other: "Other"},
            MIX_COOKING_LEVELS,
            drop=(99, 11) if a else (),
        ),
        "lightingsource": CategorySpec(
            "lightingsource",
            {**MIX_LIGHTING, other: "Other"},
            MIX_LIGHTING_LEVELS,
            drop=(99,) if a else (10,),
        ),
        "heatingsourcewater": CategorySpec(
            "heatingsourcewater", heating, MIX_HEATING_LEVELS, drop=(99,)
        ),
        "heatingsourcespace": CategorySpec(
            "heatingsourcespace", heating, MIX_HEATING_LEVELS, drop=(99,) if a else ()
        ),
    }


MIX_SPECS = {"A": _mix("A"), "C": _mix("C")}

# --- fixed values: indicator columns {name: (column, codes)} ----------------------
_FUEL_SUFFIX = {
    "elecmains": [1],
    "elecother": [2],
    "gas": [3],
    "paraffin": [4],
    "coal": [6],
    "wood": [5],
    "dung": [8],
    "solar": [9],
    "other": [10, 99],
    "noaccess": [11],
}
INDICATORS = {
    **{
        f"pro_{name}": ("province", [code])
        for code, name in enumerate(
            [
                "westerncape",
                "easterncape",
                "northerncape",
                "freestate",
                "kwazulunatal",
                "northwest",
                "gauteng",
                "mpumalanga",
                "limpopo",
            ],
            1,
        )
    },
    "urb_urban_formal": ("urban_1", [1]),
    "urb_urban_informal": ("urban_1", [2]),
    "urb_rural_traditional": ("urban_1", [4]),
    "urb_rural_formal": ("urban_1", [5]),
    "gender_male": ("gender_hhh", [1]),
    "gender_female": ("gender_hhh", [2]),
    "eth_africanblack": ("ethnicity_hhh", [1]),
    "eth_coloured": ("ethnicity_hhh", [2]),
    "eth_indian_asian": ("ethnicity_hhh", [3]),
    "eth_white": ("ethnicity_hhh", [4]),
    "edu_preprimary": ("education_hhh", [1]),
    "edu_primary": ("education_hhh", range(2, 6)),
    "edu_lower_secondary": ("education_hhh", range(6, 9)),
    "edu_upper_secondary": ("education_hhh", range(9, 15)),
    "edu_postsecondary_nontertiary": ("education_hhh", range(15, 25)),
    "edu_shortcycle_tertiary": ("education_hhh", range(25, 27)),
    "edu_bachelor_eq": ("education_hhh", range(27, 30)),
    "edu_master_eq": ("education_hhh", [30]),
    "edu_other": ("education_hhh", [31, 32]),
    "edu_no_schooling": ("education_hhh", [98]),
    "veh_own": ("own_vehicle", [1]),
    "veh_other": ("own_vehicle", [2, 9]),
    "veh_noaccess": ("own_vehicle", [3]),
    "sto_own": ("own_stove", [1]),
    "sto_other": ("own_stove", [2, 9]),
    "sto_noaccess": ("own_stove", [3]),
    # from the derived electricity source, so the priority order holds here too
    "elec_mains": ("electricitysource", ["Mains"]),
    "elec_other": ("electricitysource", ["Other"]),
    "elec_solar": ("electricitysource", ["Solar Energy"]),
    "elec_noaccess": ("electricitysource", ["No Access"]),
    "elecf_free": ("electricityfree", [1]),
    "elecf_nofree": ("electricityfree", [2]),
    "light_elecmains": ("lightingsource", [1]),
    "light_elecother": ("lightingsource", [2]),
    "light_other": ("lightingsource", [3, 10, 99]),
    "light_paraffin": ("lightingsource", [4]),
    "light_candles": ("lightingsource", [7]),
    "light_solar": ("lightingsource", [9]),
    **{f"cooking_{s}": ("cookingsource", codes) for s, codes in _FUEL_SUFFIX.items()},
    **{f"heat_w_{s}": ("heatingsourcewater", codes) for s, codes in _FUEL_SUFFIX.items()},
    **{f"heat_s_{s}": ("heatingsourcespace", codes) for s, codes in _FUEL_SUFFIX.items()},
}

# --- fixed values: term captions -------------------------------------------------
TERM_CAPTIONS = (
    ("^cookingsource", "Cooking Fuel: "),
    ("^electricitysource", "Electricity Source: "),
    ("^own_vehicle", "Car: "),
    ("^own_stove", "Stove: "),
    ("^education_hhh", "Education: "),
    ("^ethnicity_hhh", "Ethnicity:"),
    ("^urban_1", "Res. Area: "),
    ("^gender_hhh", "Gender: "),
    ("^province", "Province: "),
    ("^log_expenditures_hh", "Expenditures (log)"),
    ("^heatingsourcewater", "Heating Water: "),
    ("^heatingsourcespace", "Heating Space: "),
    ("^lightingsource", "Lighting Fuel: "),
)
CAPTION_ORDER = (
    "Expenditures (log)",
    "Province:",
    "Res. Area:",
    "Education:",
    "Ethnicity:",
    "Gender:",
    "Car:",
    "Stove:",
    "Electricity Source:",
    "Lighting Fuel:",
    "Cooking Fuel:",
    "Heating Water:",
    "Heating Space:",
)
# Captions of the indicator names in the importance table: last part, then prefix.
INDICATOR_WORDS = {
    "westerncape": "Western Cape",
    "easterncape": "Eastern Cape",
    "northerncape": "Northern Cape",
    "freestate": "Free State",
    "kwazulunatal": "KwaZulu Natal",
    "northwest": "North West",
    "gauteng": "Gauteng",
    "mpumalanga": "Mpumalanga",
    "limpopo": "Limpopo",
    "urban_formal": "Urban Formal",
    "urban_informal": "Urban Informal",
    "rural_traditional": "Rural Traditional",
    "rural_formal": "Rural Formal",
    "female": "Female",
    "male": "Male",
    "africanblack": "African Black",
    "coloured": "Coloured",
    "indian_asian": "Indian/Asian",
    "white": "White",
    "preprimary": "Pre-primary",
    "primary": "Primary",
    "lower_secondary": "Lower Secondary",
    "upper_secondary": "Upper Secondary",
    "postsecondary_nontertiary": "Post-secondary Non-tertiary",
    "shortcycle_tertiary": "Short-cycle Tertiary",
    "bachelor_eq": "Bachelor's or Equivalent",
    "master_eq": "Master's or Equivalent",
    "no_schooling": "No Schooling",
    "own": "Ownership",
    "noaccess": "No Access",
    "other": "Other",
    "mains": "Mains",
    "elecmains": "Electricity Mains",
    "elecother": "Electricity Other",
    "solar": "Solar",
    "paraffin": "Paraffin",
    "candles": "Candles",
    "gas": "Gas",
    "coal": "Coal",
    "wood": "Wood",
    "dung": "Dung",
    "free": "Free",
    "nofree": "Not Free",
}
INDICATOR_PREFIXES = (
    ("^cooking_", "Cooking Fuel: "),
    ("^elec_", "Electricity Source: "),
    ("^elecf_", "Free Electricity: "),
    ("^veh_", "Car: "),
    ("^sto_", "Stove: "),
    ("^edu_", "Education: "),
    ("^eth_", "Ethnicity: "),
    ("^urb_", "Res. Area: "),
    ("^gender_", "Gender: "),
    ("^pro_", "Province: "),
    ("^log_expenditures", "Expenditures (log)"),
    ("^heat_w_", "Heating Water: "),
    ("^heat_s_", "Heating Space: "),
    ("^light_", "Lighting Fuel: "),
)
