"""Numbers, names and formats that results must agree on."""

# Fixed values -------------------------------------------------------------------------------
NO_CALL = 255                      # written in place of a colour when there is no call
TIFF_NAME = r"(?i)\.tiff?$"        # names taken as image stacks

STATUS_RAW = "Raw"
STATUS_SHADE_CORRECTED = "Shade Corrected"
STATUS_ALIGNED = "Aligned"
STATUS_BEADS_GENERATED = "Protein Generated"
STATUS_REFERENCE = "Reference"

AXES = "CYX"
UNIT = "um"
PIXEL_SIZE = 0.3250
MAX_SIZE = 10000
CELL_MAX_SIZE = 23000
PREFIX = "changed_"
OVERLAP = 250
NUM_TILES = 10

PALETTE = [(27, 158, 119), (217, 95, 2), (117, 112, 179), (231, 41, 138)]   # channel tints, r g b
MARK = (255, 0, 0)                 # bead centre in an overlay

BBOX_FORMAT = "(%d, %d, %d, %d)"   # y1, x1, y2, x2
MATRIX_FORMAT = "Translation: (%.2f, %.2f), Rotation: %.2f°, Scale: (x: %.2f, y: %.2f)"

SURROUND_RATIO = 1.5               # surround / core mean above which a bead is corrected
CORE_MEDIAN = 5000                 # and only above this core median
LINEAR_SLOPE, LINEAR_OFFSET, LINEAR_SHIFT = 0.8266, 3970.1, 2000
NCC_REUSE = 0.3                    # below: take the previous tile's transform
NCC_STAGE_2, NCC_STAGE_3 = 0.5, 0.6
MATCH_RATIO = 0.7
MIN_POINTS = 4
RANSAC_ROUNDS = 100_000
INLIER_PX = 3.0
TRACK_SETS = [(15, 2, 10), (21, 3, 20), (31, 4, 30)]   # window side, levels above the image, steps
TRACK_EPS = 0.03
MAX_POINTS = 5000                  # key points of a tile
TRACK_ERROR = 50                   # mean difference of windows from which a point is dropped
TRACK_MIN_EIGEN = 0.1024           # least eigenvalue of the mean gradient product
ELASTIC_MESH = 8                   # spline cells along a side
ELASTIC_ROUNDS = 30
# --------------------------------------------------------------------------------------------
