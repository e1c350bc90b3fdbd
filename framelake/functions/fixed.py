"""Fixed values of the image format: names, codes and published tables.

Everything in this module is data that results must agree with, kept together and in natural order.
"""

# --- Fixed values: transform names, orientation rules --------------------------------------------
NONE = "none"
FLIP_H = "flip_h"
FLIP_V = "flip_v"
TRANSPOSE = "transpose"
TRANSVERSE = "transverse"
ROT_90 = "rot_90"
ROT_180 = "rot_180"
ROT_270 = "rot_270"
WIPE = "wipe"

# Transforms that swap the axes, and those that mirror the destination horizontally / vertically.
SWAPS_AXES = (TRANSPOSE, TRANSVERSE, ROT_90, ROT_270)
MIRRORS_X = (FLIP_H, ROT_90, ROT_180, TRANSVERSE)
MIRRORS_Y = (FLIP_V, ROT_180, ROT_270, TRANSVERSE)

# orientation, transform, m11, m12, m21, m22, inverse (same order), axes swap, thumbnail flip, thumbnail turn
ORIENTATION_ROWS = (
    (0, NONE, 1, 0, 0, 1, 1, 0, 0, 1, False, "none", 0),
    (1, NONE, 1, 0, 0, 1, 1, 0, 0, 1, False, "none", 0),
    (2, FLIP_H, -1, 0, 0, 1, -1, 0, 0, 1, False, "h", 0),
    (3, ROT_180, -1, 0, 0, -1, -1, 0, 0, -1, False, "none", 180),
    (4, FLIP_V, 1, 0, 0, -1, 1, 0, 0, -1, False, "v", 0),
    (5, TRANSPOSE, 0, 1, 1, 0, 0, 1, 1, 0, True, "h", 270),
    (6, ROT_90, 0, 1, -1, 0, 0, -1, 1, 0, True, "none", 90),
    (7, TRANSVERSE, 0, -1, -1, 0, 0, -1, -1, 0, True, "v", 270),
    (8, ROT_270, 0, -1, 1, 0, 0, 1, -1, 0, True, "none", 270),
)
ORIENTATION_SCHEMA = (
    "orientation int, transform string, m11 int, m12 int, m21 int, m22 int, "
    "i11 int, i12 int, i21 int, i22 int, axes_swap boolean, thumb_flip string, thumb_turn int"
)

# --- Fixed values: marker codes ------------------------------------------------------------------
SOF0, SOF1, SOF2, SOF9, SOF10 = 0xC0, 0xC1, 0xC2, 0xC9, 0xCA
SUPPORTED_SOF = (SOF0, SOF1, SOF2, SOF9, SOF10)
UNSUPPORTED_SOF = (0xC3, 0xC5, 0xC6, 0xC7, 0xC8, 0xCB, 0xCD, 0xCE, 0xCF)
DHT, DAC, RST0, RST7 = 0xC4, 0xCC, 0xD0, 0xD7
SOI, EOI, SOS, DQT, DNL, DRI = 0xD8, 0xD9, 0xDA, 0xDB, 0xDC, 0xDD
APP0, APP1, APP14, APP15, LSE, COM, TEM = 0xE0, 0xE1, 0xEE, 0xEF, 0xF8, 0xFE, 0x01

# --- Fixed values: limits ------------------------------------------------------------------------
DCT_SIZE = 8
BLOCK_LEN = 64
MAX_DIMENSION = 65500
MAX_COMPONENTS = 10
MAX_SAMPLING = 4
MAX_BLOCKS_IN_MCU = 10
TABLE_SLOTS = 4
EXTENSIONS = ("jpg", "jpeg", "jpe", "jif", "jfif", "jfi")

# --- Fixed values: EXIF tags ---------------------------------------------------------------------
TAG_ORIENTATION = 274
TAG_EXIF_IFD = 0x8769
TAG_SUBJECT_AREA = 37396
TAG_SUBJECT_LOCATION = 41492
TAG_FOCAL_X = 41486
TAG_FOCAL_Y = 41487
TAG_EXIF_WIDTH = 0xA002
TAG_EXIF_HEIGHT = 0xA003

# --- Fixed values: standard quantisation tables (natural order) -----------------------------------
LUMA_QUANT = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA_QUANT = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)

# --- Fixed values: standard entropy tables, as code counts per length and symbols in code order ---
DC_LUMA_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_CHROMA_COUNTS = (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
AC_LUMA_COUNTS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
AC_LUMA_SYMBOLS = (
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07,
    0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0,
    0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28,
    0x29, 0x2A, 0x34, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49,
    0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69,
    0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89,
    0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7,
    0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5,
    0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2,
    0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8,
    0xF9, 0xFA,
)
AC_CHROMA_COUNTS = (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)
AC_CHROMA_SYMBOLS = (
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71,
    0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0,
    0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26,
    0x27, 0x28, 0x29, 0x2A, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48,
    0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68,
    0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87,
    0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5,
    0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3,
    0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA,
    0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8,
    0xF9, 0xFA,
)

# --- Fixed values: the ten-scan progressive script for three-component luma/chroma images ---------
# component list, first and last coefficient, previous and current bit position
YCC_SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    ((0,), 1, 5, 0, 2),
    ((2,), 1, 63, 0, 1),
    ((1,), 1, 63, 0, 1),
    ((0,), 6, 63, 0, 2),
    ((0,), 1, 63, 2, 1),
    ((0, 1, 2), 0, 0, 1, 0),
    ((2,), 1, 63, 1, 0),
    ((1,), 1, 63, 1, 0),
    ((0,), 1, 63, 1, 0),
)

# --- Fixed values: default components per colour space --------------------------------------------
# space, component index, id, h, v, quantiser slot, entropy slot
DEFAULT_COMPONENTS = (
    ("gray", 0, 1, 1, 1, 0, 0),
    ("rgb", 0, 0x52, 1, 1, 0, 0), ("rgb", 1, 0x47, 1, 1, 0, 0), ("rgb", 2, 0x42, 1, 1, 0, 0),
    ("ycc", 0, 1, 2, 2, 0, 0), ("ycc", 1, 2, 1, 1, 1, 1), ("ycc", 2, 3, 1, 1, 1, 1),
    ("cmyk", 0, 0x43, 1, 1, 0, 0), ("cmyk", 1, 0x4D, 1, 1, 0, 0), ("cmyk", 2, 0x59, 1, 1, 0, 0),
    ("cmyk", 3, 0x4B, 1, 1, 0, 0),
    ("ycck", 0, 1, 2, 2, 0, 0), ("ycck", 1, 2, 1, 1, 1, 1), ("ycck", 2, 3, 1, 1, 1, 1),
    ("ycck", 3, 4, 2, 2, 0, 0),
    ("bg_rgb", 0, 0x72, 1, 1, 0, 0), ("bg_rgb", 1, 0x67, 1, 1, 0, 0), ("bg_rgb", 2, 0x62, 1, 1, 0, 0),
    ("bg_ycc", 0, 1, 2, 2, 0, 0), ("bg_ycc", 1, 0x22, 1, 1, 1, 1), ("bg_ycc", 2, 0x23, 1, 1, 1, 1),
)

# --- Fixed values: status texts -------------------------------------------------------------------
MESSAGES = (
    ("en-US", "analysedMany", "Analyzed %lu images"),
    ("en-US", "analysedOne", "Analyzed 1 image"),
    ("en-US", "processedMany", "Rotated %lu/%lu images"),
    ("en-US", "processedOne", "Rotating image"),
    ("en-US", "processedAllMany", "Rotated all %lu images"),
    ("en-US", "processedAllOne", "Rotated image"),
    ("en-US", "noImagesToBeRotated", "There were no rotatable images in your selection"),
    ("en-US", "noJPEGsInDirectory", "There were no JPG files in your selection"),
    ("en-US", "cropOptionRequired", 'Enable the "Crop" option to rotate this image'),
    ("en-US", "imageReadOnly", "This image is read-only"),
    ("en-GB", "analysedMany", "Analysed %lu images"),
    ("en-GB", "analysedOne", "Analysed 1 image"),
    ("en-GB", "processedMany", "Rotated %lu/%lu images"),
    ("en-GB", "processedOne", "Rotating image"),
    ("en-GB", "processedAllMany", "Rotated all %lu images"),
    ("en-GB", "processedAllOne", "Rotated image"),
    ("en-GB", "noImagesToBeRotated", "There were no rotatable images in your selection"),
    ("en-GB", "noJPEGsInDirectory", "There were no JPG files in your selection"),
    ("en-GB", "cropOptionRequired", 'Enable the "Crop" option to rotate this image'),
    ("en-GB", "imageReadOnly", "This image is read-only"),
    ("ru", "analysedMany", "Проанализировано %lu изображений"),
    ("ru", "analysedOne", "Проанализировано 1 изображение"),
    ("ru", "processedMany", "%lu/%lu изображение обработанные"),
    ("ru", "processedOne", "Идет обработ изображения"),
    ("ru", "processedAllMany", "Все %lu изображение обработанные"),
    ("ru", "processedAllOne", "Изображение обработанно"),
    ("ru", "noImagesToBeRotated", "В вашем выборе не было вращяемых изображений"),
    ("ru", "cropOptionRequired", 'Включите параметр "Обрезать" чтобы повернуть это изображение'),
    ("ru", "imageReadOnly", "У этого изображения атрибут только для чтения"),
)
