"""Fixed values of the data contract.

Every one of them is only the default of a keyword parameter.
"""

# Image resolution tiers (pixels), aspect range, file sizes (bytes).
INPUT_SIZE = 300
RESIZE_SIZE = 320
IDEAL_SIZE = 450
SEVERE_SIZE = 150
MIN_ASPECT = 0.35
MAX_ASPECT = 2.85
TINY_FILE_BYTES = 5 * 1024
LARGE_FILE_BYTES = 10 * 1024 * 1024

# Images per class.
MIN_PER_CLASS = 150
IDEAL_PER_CLASS = 400

# Perceptual hashing and report examples.
HASH_SIDE = 8
HAMMING_LIMIT = 5
EXAMPLE_COUNT = 15

# Uploads, history listing, scoring.
MAX_UPLOAD_BYTES = 5 * 1024 * 1024
UPLOAD_CONTENT_TYPES = ("image/jpeg", "image/png")
UPLOAD_FORMATS = ("JPEG", "PNG")
HISTORY_LIMIT = 100
HISTORY_QUERY_CHARS = 100
LOW_CONFIDENCE = 0.50
TOP_K = 5

# Model input and training weights.
MODEL_NAME = "EfficientNet-B3"
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
BALANCE_BETA = 0.9999
LABEL_SMOOTHING = 0.1
PATIENCE = 6

# Closed domains.
SPLITS = ("train", "val", "test")
CATEGORIES = ("all", "disease", "healthy")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")

# Colour mode -> channel count.
MODE_CHANNELS = {
    "1": 1, "L": 1, "LA": 2, "P": 1, "RGB": 3,
    "RGBA": 4, "CMYK": 4, "YCbCr": 3, "I": 1, "F": 1,
}
GRAYSCALE_MODES = ("1", "L", "LA")
