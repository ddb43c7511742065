"""Ordered product keyword rules and category label maps.

Rules are tried top to bottom; the first one with a keyword inside the name wins.
"""

# (category, subcategory, keywords)
PRODUCT_RULES = [
    ("Maternity & Baby Care", "Pregnancy Pillow", ["pregnancy", "maternity"]),
    ("Maternity & Baby Care", "Baby Care", ["baby", "infant", "nursing", "feeding pillow", "kids"]),
    ("Orthopedic & Wellness", "Flat Feet Combo", ["flat feet", "flat foot", "flatfeet"]),
    ("Comfort & Sleep", "Bundles", ["combo", "bundle"]),
    ("Footwear", "Barefoot", ["barefoot", "sock shoe", "skinners"]),
    ("Mobility", "Wheelchair", ["wheelchair", "wheel chair"]),
    ("Mobility", "Mobility Scooter", ["mobility scooter", "scooter"]),
    ("Mobility", "Transfer & Lift Aids", ["transfer lift", "patient lift", "transfer aid", "hoist", "walker", "rollator", "crutch"]),
    ("Mobility", "Commode", ["commode"]),
    ("Mobility", "Bathroom Safety", ["bath mat", "anti-slip", "anti slip", "grab bar", "bed rail", "shower stool", "shower chair", "ramp"]),
    ("Furniture", "Ergonomic Chair", ["ergonomic chair", "ergo chair", "office chair", "gaming chair", "study chair"]),
    ("Furniture", "Recliner", ["recliner"]),
    ("Furniture", "Chair", ["chair"]),
    ("Furniture", "Standing Desk", ["standing desk", "height desk", "adjustable desk"]),
    ("Furniture", "Desk & Table", ["laptop table", "study table", "work table", "desk", "workstation"]),
    ("Furniture", "Stand & Mount", ["laptop stand", "monitor stand", "monitor arm", "monitor mount", "laptop mount", "laptop holder", "monitor", "foot rest", "footrest"]),
    ("Footwear", "Insoles", ["insole", "arch support", "shoe insert", "foot insert"]),
    ("Footwear", "Socks", ["sock"]),
    ("Orthopedic & Wellness", "Face Mask", ["face mask", "n95", "n-95", "anti pollution", "anti-pollution", "pollution mask", "surgical mask"]),
    ("Comfort & Sleep", "Topper", ["mattress topper", "topper"]),
    ("Comfort & Sleep", "Protector", ["mattress protector", "mattress"]),
    ("Comfort & Sleep", "Covers", ["cuddle cover", "wedge cover", "pillow cover", "cushion cover", "seat cover", "replacement cover", "cover"]),
    ("Comfort & Sleep", "Neck Pillow", ["neck pillow", "cervical", "neck contour", "travel pillow"]),
    ("Comfort & Sleep", "Wedge Pillow", ["wedge"]),
    ("Comfort & Sleep", "Sleep Pillow", ["sleep pillow", "cozy pillow", "memory foam pillow", "bed pillow", "pillow"]),
    ("Comfort & Sleep", "Seat Cushion", ["seat cushion", "donut", "coccyx", "seat"]),
    ("Comfort & Sleep", "Backrest", ["backrest", "back rest", "lumbar cushion", "lumbar"]),
    ("Comfort & Sleep", "Cushion", ["cushion"]),
    ("Footwear", "Sandals", ["sandal"]),
    ("Footwear", "Slippers", ["slipper", "flip flop", "flipflop", "clog", "chappal"]),
    ("Footwear", "Shoes", ["shoe", "sneaker", "footwear"]),
    ("Orthopedic & Wellness", "Posture Corrector", ["posture"]),
    ("Orthopedic & Wellness", "Knee & Joint Support", ["knee", "ankle", "elbow", "wrist", "shoulder"]),
    ("Orthopedic & Wellness", "Braces & Wraps", ["brace", "wrap", "lumbo sacral", "sacral", "compression", "support belt", "belt", "support"]),
    ("Orthopedic & Wellness", "Foot Care", ["bunion", "heel", "plantar", "toe", "arch", "orthotic", "foot"]),
    ("Orthopedic & Wellness", "Sleep & Eye Mask", ["eye mask", "sleep mask", "mask"]),
    ("Orthopedic & Wellness", "Hot/Cold Therapy", ["therapy", "hot & cold", "cold & hot", "heating pad", "heat pad"]),
    ("Orthopedic & Wellness", "Nasal Care", ["nasal", "nose"]),
    ("Orthopedic & Wellness", "Massage & Relief", ["massager", "massage", "roller", "pain relief", "pain-relief", "kinesiology", "tape"]),
    ("Orthopedic & Wellness", "Gloves", ["glove"]),
    ("Accessories & Others", "Wallet", ["wallet", "card holder", "cardholder"]),
    ("Accessories & Others", "Spare Parts", ["spare part", "sparepart", "castor wheel", "castor", "joystick"]),
    ("Accessories & Others", "Accessories", ["strap", "pouch", "bag", "cap", "accessor"]),
]
PRODUCT_DEFAULT = ("Accessories & Others", "Other")
PRODUCT_BLANK = ("Unknown", "Unknown")

# Catalogue category -> display group.
DISPLAY_GROUP = {
    "Pillows": "Comfort & Sleep",
    "Cushions": "Comfort & Sleep",
    "Mattress Topper Protector": "Comfort & Sleep",
    "Covers": "Comfort & Sleep",
    "Bundles": "Comfort & Sleep",
    "Footwear": "Footwear",
    "Barefoot": "Footwear",
    "Insoles": "Footwear",
    "Socks": "Footwear",
    "Orthotics": "Orthopedic & Wellness",
    "Personal Care": "Orthopedic & Wellness",
    "Masks": "Orthopedic & Wellness",
    "Mobility Devices": "Mobility",
    "Mobility": "Mobility",
    "Chairs": "Furniture",
    "Workspace": "Furniture",
    "Furniture": "Furniture",
    "Maternity & Baby Care": "Maternity & Baby Care",
    "Accessories": "Accessories & Others",
    "Accessories & Others": "Accessories & Others",
    "Others": "Accessories & Others",
    "Unknown": "Accessories & Others",
}

# Invoice lines: (category, keywords)
INVOICE_RULES = [
    ("Maternity & Baby Care", ["pregnancy", "maternity", "baby", "infant", "nursing", "feeding pillow"]),
    ("Barefoot", ["barefoot", "sock shoe", "skinners"]),
    ("Mobility Devices", ["wheelchair", "commode", "scooter", "walker", "rollator", "transfer lift", "bed rail", "grab bar", "guardrail", "safety rail", "ramp", "crutch", "bath mat", "shower stool", "shower chair", "mobility"]),
    ("Chairs", ["ergo chair", "ergonomic chair", "executive chair", "gaming chair", "office chair", "ergoluxe", "ergo luxe", "posture plus chair", "study chair", "recliner", "chair"]),
    ("Workspace", ["standing desk", "desk converter", "desk", "laptop table", "study table", "work table", "laptop stand", "monitor stand", "monitor arm", "monitor mount", "laptop mount", "laptop holder", "monitor", "workstation", "footrest", "foot rest"]),
    ("Insoles", ["insole", "arch support", "arch cushion", "shoe insert", "foot insert", "arch sports"]),
    ("Socks", ["sock"]),
    ("Masks", ["face mask", "n95", "n-95", "anti pollution", "anti-pollution", "pollution mask", "surgical mask"]),
    ("Mattress Topper Protector", ["mattress topper", "mattress protector", "mattress", "topper"]),
    ("Covers", ["cuddle cover", "wedge cover", "pillow cover", "cushion cover", "seat cover", "replacement cover", "cover"]),
    ("Pillows", ["neck pillow", "cervical", "wedge", "travel pillow", "memory foam pillow", "sleep pillow", "cozy pillow", "pillow"]),
    ("Cushions", ["seat cushion", "coccyx", "donut", "backrest", "back rest", "lumbar", "cushion", "seat"]),
    ("Footwear", ["sandal", "slipper", "chappal", "flip flop", "flipflop", "clog", "sneaker", "footwear", "shoe"]),
    ("Orthotics", ["posture", "orthotic", "knee", "ankle", "elbow", "wrist", "shoulder", "brace", "wrap", "support belt", "lumbo", "sacral", "bunion", "heel", "plantar", "toe", "compression", "belt", "support"]),
    ("Personal Care", ["eye mask", "sleep mask", "mask", "therapy", "heating pad", "heat pad", "nasal", "nose", "massager", "massage", "roller", "pain relief", "kinesiology", "tape", "glove"]),
    ("Accessories", ["cap", "pouch", "bag", "strap", "wallet", "card holder", "cardholder", "spare part", "sparepart", "castor", "joystick", "accessor", "combo"]),
]
INVOICE_DEFAULT = "Others"

# Category label as written in a master file -> invoice category.
EXPLICIT_CATEGORY = {
    "orthotics": "Orthotics", "orthotic": "Orthotics",
    "footwear": "Footwear", "footwears": "Footwear", "shoes": "Footwear",
    "insole": "Insoles", "insoles": "Insoles",
    "pillows": "Pillows", "pillow": "Pillows",
    "cushion": "Cushions", "cushions": "Cushions",
    "mattress topper": "Mattress Topper Protector", "mattress": "Mattress Topper Protector",
    "topper": "Mattress Topper Protector",
    "socks": "Socks", "sock": "Socks",
    "covers": "Covers", "cover": "Covers", "cuddle covers": "Covers", "wedge covers": "Covers",
    "cap": "Accessories", "accessories": "Accessories", "accessory": "Accessories",
    "sparepart (chair & mobility)": "Accessories", "sparepart": "Accessories",
    "gloves": "Accessories", "furnishing": "Accessories",
    "mask": "Masks", "masks": "Masks",
    "eye mask": "Personal Care", "personal care": "Personal Care",
    "maternity": "Maternity & Baby Care", "baby": "Maternity & Baby Care",
    "barefoot": "Barefoot",
    "chairs": "Chairs", "chair": "Chairs",
    "workspace": "Workspace",
    "mobility": "Mobility Devices", "wheelchairs": "Mobility Devices", "wheelchair": "Mobility Devices",
}
