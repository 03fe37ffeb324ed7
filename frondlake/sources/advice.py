"""Advice on the known disorders, in short points.

Advice follows the kind of the disorder; what is special about a class comes
first. A CSV of points (``guidance.read_points``) replaces it.
"""

from __future__ import annotations

# kind -> (causes, cure, prevention)
KINDS: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "fungus": (
        ("Leaves that stay wet for many hours", "Spores that survive on old plant parts"),
        ("Cut out the worst leaves and take them off the field.", "Ask which fungicide is allowed for this crop and spray early."),
        ("Choose varieties bred for resistance.", "Water the soil, not the leaves.", "Leave room between plants so that leaves dry."),
    ),
    "bacterium": (
        ("Rain or sprinklers that splash bacteria onto leaves", "Seed, seedlings or tools that carry bacteria"),
        ("Take away plants or twigs with spots while leaves are dry.", "Copper sprays can slow new spots; they heal none."),
        ("Start from tested seed and clean seedlings.", "Stay out of wet rows.", "Disinfect tools between plants."),
    ),
    "virus": (
        ("Insects or hands that carry sap from sick plants", "Weeds and old plants that keep the virus alive"),
        ("No spray cures it: pull sick plants and bag them.", "Keep the insects that spread it under control."),
        ("Grow resistant varieties.", "Wash hands and tools before touching healthy plants.", "Clear weeds around the field."),
    ),
    "pest": (
        ("Hot, dry and dusty weather", "Broad insecticides that kill the pest's natural enemies"),
        ("Rinse the undersides of leaves with a strong jet of water.", "Use soap or oil sprays that spare natural enemies."),
        ("Look at leaf undersides every week in warm weather.", "Keep plants watered and paths free of dust."),
    ),
    "disorder": (
        ("Too little or too much water", "Soil or roots that hinder the uptake of nutrients"),
        ("Check soil moisture at root depth and correct watering.", "Have leaves or soil tested before adding fertilizer."),
        ("Mulch to keep moisture even.", "Feed in small amounts at the right season."),
    ),
}

# class key -> (kind, special cause, special cure, special prevention)
CLASSES: dict[str, tuple[str, str, str, str]] = {
    "corn__cercospora_leaf_spot_gray_leaf_spot": (
        "fungus", "Warm, very humid spells over corn stubble", "Protect the ear leaf around tasseling if spots climb.", "Follow corn with another crop."),
    "corn__common_rust": (
        "fungus", "Cool, damp weather and spores from far away", "Treat sweet corn only if pustules come early.", "Sow at the usual time of the region."),
    "corn__northern_leaf_blight": (
        "fungus", "Mild days with long dew", "Protect upper leaves before silks dry.", "Bury or remove stubble before the next corn."),
    "lemon__anthracnose": (
        "fungus", "Weak twigs and dead wood in foggy weather", "Prune dead twigs back to sound wood.", "Keep trees strong and free of wounds."),
    "lemon__bacterial_blight": (
        "bacterium", "Wind-driven rain on tender shoots", "Prune blighted shoots well below the damage.", "Shelter the grove from wind."),
    "lemon__citrus_canker": (
        "bacterium", "Storms and leaf miner wounds", "Report it: removal may be required by law.", "Buy certified trees only."),
    "lemon__curl_virus": (
        "virus", "Aphids, thrips or other sap feeders on new leaves", "Find out first whether insects or a virus curl the leaves.", "Watch each new flush for insects."),
    "lemon__deficiency_leaf": (
        "disorder", "Soil that is poor, cold or too alkaline", "Supply the nutrient that the test shows to be short.", "Keep the soil slightly acid."),
    "lemon__dry_leaf": (
        "disorder", "Heat, dry wind or salty water", "Water slowly and deeply until the root zone is moist.", "Shade young trees in heat waves."),
    "lemon__sooty_mould": (
        "pest", "Honeydew of aphids, scales or whiteflies", "Remove the insects; the black film then wears off.", "Keep ants off the trunk: they guard the insects."),
    "lemon__spider_mites": (
        "pest", "Drought-stressed trees", "Spray citrus oil in mild weather if predators are few.", "Water regularly in dry months."),
    "pepper__bacterial_spot": (
        "bacterium", "Warm rain and infected seed", "Drop the worst plants from the row at once.", "Grow peppers elsewhere for two years."),
    "tomato__bacterial_spot": (
        "bacterium", "Warm rain and volunteer tomatoes", "Begin copper at the first spots if rain goes on.", "Remove volunteers and nightshade weeds."),
    "tomato__early_blight": (
        "fungus", "Old lower leaves close to the soil", "Strip spotted lower leaves.", "Stake plants and mulch below them."),
    "tomato__late_blight": (
        "fungus", "Cool, wet weather and infected potatoes nearby", "Destroy sick plants at once; it spreads in days.", "Plant sound potatoes and remove volunteers."),
    "tomato__leaf_mold": (
        "fungus", "Greenhouse air above 85 % humidity", "Air and heat the house to dry the leaves.", "Vent early in the morning."),
    "tomato__mosaic_virus": (
        "virus", "Sap on hands, tools and trellis", "Do not compost sick plants.", "Do not handle tobacco before working with plants."),
    "tomato__septoria_leaf_spot": (
        "fungus", "Rain that splashes soil onto low leaves", "Pick spotted leaves from the bottom up.", "Leave tomatoes out of the bed for two years."),
    "tomato__spider_mites_two_spotted_spider_mite": (
        "pest", "Weeks of heat without rain", "Release or spare predatory mites.", "Do not overfeed with nitrogen."),
    "tomato__target_spot": (
        "fungus", "Dense leaves in warm, humid air", "Thin the canopy and treat before fruits set.", "Keep away from old tomato beds."),
    "tomato__yellow_leaf_curl_virus": (
        "virus", "Whiteflies that come from sick fields", "Trap and control whiteflies from the first day.", "Raise seedlings under fine net."),
}


def advice(class_key: str) -> tuple[list[str], list[str], list[str]]:
    """Causes, cure and prevention of a class."""
    kind, *special = CLASSES[class_key]
    return tuple([own, *general] for own, general in zip(special, KINDS[kind]))
