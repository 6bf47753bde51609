"""Fixed values of public data sets: class names, palettes, id lists, folder conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names, colours and file suffixes of the public data sets.
CITYSCAPES_CLASSES = ("road", "sidewalk", "building", "wall", "fence", "pole", "traffic light", "traffic sign",
                      "vegetation", "terrain", "sky", "person", "rider", "car", "truck", "bus", "train", "motorcycle", "bicycle")
CITYSCAPES_PALETTE = ((128, 64, 128), (244, 35, 232), (70, 70, 70), (102, 102, 156), (190, 153, 153), (153, 153, 153),
                      (250, 170, 30), (220, 220, 0), (107, 142, 35), (152, 251, 152), (70, 130, 180), (220, 20, 60),
                      (255, 0, 0), (0, 0, 142), (0, 0, 70), (0, 60, 100), (0, 80, 100), (0, 0, 230), (119, 11, 32))
# Training id to submission id.
CITYSCAPES_TRAIN_TO_ID = {0: 7, 1: 8, 2: 11, 3: 12, 4: 13, 5: 17, 6: 19, 7: 20, 8: 21, 9: 22, 10: 23, 11: 24, 12: 25,
                          13: 26, 14: 27, 15: 28, 16: 31, 17: 32, 18: 33}
# Fixed values: [lo, hi) class ranges of the seven coarse groups.
CITYSCAPES_GROUPS = (("flat", 0, 2), ("construction", 2, 5), ("object", 5, 8), ("nature", 8, 10), ("sky", 10, 11),
                     ("human", 11, 13), ("vehicle", 13, 19))
VOC_CLASSES = ("background", "aeroplane", "bicycle", "bird", "boat", "bottle", "bus", "car", "cat", "chair", "cow",
               "diningtable", "dog", "horse", "motorbike", "person", "pottedplant", "sheep", "sofa", "train", "tvmonitor")
ISAID_CLASSES = ("background", "ship", "store_tank", "baseball_diamond", "tennis_court", "basketball_court",
                 "Ground_Track_Field", "Bridge", "Large_Vehicle", "Small_Vehicle", "Helicopter", "Swimming_pool",
                 "Roundabout", "Soccer_ball_field", "plane", "Harbor")
ISAID_PALETTE = ((0, 0, 0), (0, 0, 63), (0, 63, 63), (0, 63, 0), (0, 63, 127), (0, 63, 191), (0, 63, 255), (0, 127, 63),
                 (0, 127, 127), (0, 0, 127), (0, 0, 191), (0, 0, 255), (0, 191, 127), (0, 127, 191), (0, 127, 255), (0, 100, 155))
ISPRS_CLASSES = ("impervious_surface", "building", "low_vegetation", "tree", "car", "clutter")
ISPRS_PALETTE = ((255, 255, 255), (0, 0, 255), (0, 255, 255), (0, 255, 0), (255, 255, 0), (255, 0, 0))
LOVEDA_CLASSES = ("background", "building", "road", "water", "barren", "forest", "agricultural")
LOVEDA_PALETTE = ((255, 255, 255), (255, 0, 0), (255, 255, 0), (0, 0, 255), (159, 129, 183), (0, 255, 0), (255, 195, 128))
SYNAPSE_CLASSES = ("background", "aorta", "gallbladder", "left_kidney", "right_kidney", "liver", "pancreas", "spleen", "stomach")
VESSEL_CLASSES = ("background", "vessel")
VESSEL_PALETTE = ((120, 120, 120), (6, 230, 230))
LEVIR_CLASSES = ("background", "changed")
LEVIR_PALETTE = ((0, 0, 0), (255, 255, 255))
# Colours of the tile converters, in class order, channels as stored.
TILE_COLOURS = ((0, 0, 0), (255, 255, 255), (255, 0, 0), (255, 255, 0), (0, 255, 0), (0, 255, 255), (0, 0, 255))
# Stuff ids that do not occur (0-based); the others are numbered in order.
STUFF_GAPS = (11, 25, 28, 29, 44, 65, 67, 68, 70, 82, 90)
STUFF_IDS = 182
# Context ids of the 60 classes kept.
CONTEXT_IDS = (0, 2, 259, 260, 415, 324, 9, 258, 144, 18, 19, 22, 23, 397, 25, 284, 158, 159, 416, 33, 162, 420, 454,
               295, 296, 427, 44, 45, 46, 308, 59, 440, 445, 31, 232, 65, 354, 424, 68, 326, 72, 458, 34, 207, 80, 355,
               85, 347, 220, 349, 360, 98, 187, 104, 105, 366, 189, 368, 113, 115)
# Abdominal organ ids kept, with their new label; all others are background.
ORGAN_LABELS = {8: 1, 4: 2, 3: 3, 2: 4, 6: 5, 11: 6, 1: 7, 7: 8}
# Data set, image suffix, annotation suffix, zero label reduced.
DATASET_FILES = (
    ("ade", ".jpg", ".png", True), ("bdd100k", ".jpg", ".png", False), ("chase_db1", ".png", "_1stHO.png", False),
    ("cityscapes", "_leftImg8bit.png", "_gtFine_labelTrainIds.png", False), ("coco_stuff", ".jpg", "_labelTrainIds.png", False),
    ("dark_zurich", "_rgb_anon.png", "_gt_labelTrainIds.png", False), ("drive", ".png", "_manual1.png", False),
    ("hrf", ".png", ".png", False), ("hsi_drive", ".npy", ".png", False), ("isaid", ".png", "_instance_color_RGB.png", False),
    ("isprs", ".png", ".png", True), ("levir", ".png", ".png", False), ("lip", ".jpg", ".png", False),
    ("loveda", ".png", ".png", True), ("mapillary", ".jpg", ".png", False),
    ("night_driving", "_leftImg8bit.png", "_gtCoarse_labelTrainIds.png", False), ("pascal_context", ".jpg", ".png", False),
    ("pascal_context_59", ".jpg", ".png", True), ("potsdam", ".png", ".png", True), ("refuge", ".png", ".png", False),
    ("stare", ".png", ".ah.png", False), ("synapse", ".jpg", ".png", False), ("voc", ".jpg", ".png", False))
# Other names a data set is known by.
ALIASES = {"cityscapes": ("cityscapes",), "voc": ("voc", "pascal_voc", "voc12", "voc12aug"), "loveda": ("loveda",),
           "potsdam": ("potsdam",), "vaihingen": ("vaihingen",), "isaid": ("isaid", "iSAID"), "drive": ("drive",),
           "stare": ("stare",), "hrf": ("hrf",), "chase_db1": ("chase_db1",), "levir": ("levir", "levircd")}


def voc_palette(n: int) -> tuple[tuple[int, int, int], ...]:
    """Bit-interleaved colour rule: bit k of the class goes to the high end of channel k mod 3."""
    def colour(c: int) -> tuple[int, int, int]:
        return tuple(sum(((c >> (3 * j + ch)) & 1) << (7 - j) for j in range(8)) for ch in range(3))
    return tuple(colour(c) for c in range(n))


def dense_map(count: int, gaps: tuple[int, ...]) -> dict[int, int]:
    """Number the ids that occur, in order."""
    return {old: new for new, old in enumerate(i for i in range(count) if i not in set(gaps))}


def known_classes() -> dict[str, tuple[tuple[str, ...], tuple[tuple[int, int, int], ...]]]:
    vessel = (VESSEL_CLASSES, VESSEL_PALETTE)
    isprs = (ISPRS_CLASSES, ISPRS_PALETTE)
    return {"cityscapes": (CITYSCAPES_CLASSES, CITYSCAPES_PALETTE), "voc": (VOC_CLASSES, voc_palette(21)),
            "isaid": (ISAID_CLASSES, ISAID_PALETTE), "potsdam": isprs, "vaihingen": isprs,
            "loveda": (LOVEDA_CLASSES, LOVEDA_PALETTE), "drive": vessel, "stare": vessel, "hrf": vessel,
            "chase_db1": vessel, "levir": (LEVIR_CLASSES, LEVIR_PALETTE)}


def class_tables(spark: SparkSession) -> DataFrame:
    """(dataset, class_id, class_name, r, g, b) of the data sets above; a dimension of fixed size."""
    rows = [(ds, i, n, *rgb) for ds, (names, pal) in known_classes().items() for i, (n, rgb) in enumerate(zip(names, pal))]
    return spark.createDataFrame(rows, "dataset string, class_id int, class_name string, r int, g int, b int")


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ds, a) for ds, names in ALIASES.items() for a in names], "dataset string, alias string")


def file_conventions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DATASET_FILES), "dataset string, img_suffix string, seg_suffix string, reduce_zero boolean")
