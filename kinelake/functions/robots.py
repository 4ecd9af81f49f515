"""Scalar and joint-vector conversions of particular robots."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two-arm robot's gripper geometry (metres, radians), joint signs and gripper dimensions.
ARM_LENGTH, HORN_RADIUS = 0.036, 0.022
LINEAR_RANGE = (0.01844, 0.05800)
ANGULAR_RANGE = (0.5476, 1.6296)
ANGULAR_OFFSET, TRAINED_RANGE = 0.5476, (-0.6213, 1.4910)
JOINT_SIGNS = (1, -1, -1, 1, 1, 1, 1) * 2
GRIPPERS = (6, 13)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rescale(x: Column, low: float, high: float) -> Column:
    """low and high map to 0 and 1."""
    return (x - low) / (high - low)


def unrescale(x: Column, low: float, high: float) -> Column:
    return x * (high - low) + low


@dataclass(frozen=True)
class Gripper:
    """A gripper's limits, shut and open: of a finger's position in metres, of its motor's angle in radians."""

    position: tuple[float, float]
    joint: tuple[float, float]

    def position_share(self, x: Column) -> Column:
        """A position as 0 (shut) to 1 (open)."""
        return rescale(x, *self.position)

    def position_of(self, share: Column) -> Column:
        return unrescale(share, *self.position)

    def joint_share(self, x: Column) -> Column:
        return rescale(x, *self.joint)

    def joint_of(self, share: Column) -> Column:
        return unrescale(share, *self.joint)

    def velocity_share(self, v: Column) -> Column:
        """A speed of the finger in strokes a second."""
        return v / (self.position[1] - self.position[0])

    def joint_at(self, position: Column) -> Column:
        return self.joint_of(self.position_share(position))

    def position_at(self, joint: Column) -> Column:
        return self.position_of(self.joint_share(joint))

    @property
    def joint_mid(self) -> float:
        return sum(self.joint) / 2


# Limits of the grippers of the two-arm robot's leading and following arms.
LEADER = Gripper((0.01244, 0.02417), (-0.6842, 0.3083))
FOLLOWER = Gripper((0.01844, 0.05800), (-0.6213, 1.4910))


def followed_position(x: Column) -> Column:
    """The following gripper's position for the leading one's."""
    return FOLLOWER.position_of(LEADER.position_share(x))


def followed_joint(x: Column) -> Column:
    return FOLLOWER.joint_of(LEADER.joint_share(x))


def gripper_to_angular(opening: Column) -> Column:
    """A gripper's opening, 0 to 1, as the angle, 0 to 1, of the motor that makes it."""
    p = unrescale(opening, *LINEAR_RANGE)
    ratio = (HORN_RADIUS**2 + p * p - ARM_LENGTH**2) / (2 * HORN_RADIUS * p)
    return rescale(F.asin(clip(ratio, -1.0, 1.0)), *ANGULAR_RANGE)


def gripper_from_angular(angle: Column) -> Column:
    """A model's gripper output as the robot's scale."""
    return rescale(angle + ANGULAR_OFFSET, *TRAINED_RANGE)


def gripper_from_angular_inverse(x: Column) -> Column:
    return unrescale(x, *TRAINED_RANGE) - ANGULAR_OFFSET


def _joints(x: Column, gripper) -> Column:
    signs = F.array(*[F.lit(float(s)) for s in JOINT_SIGNS])
    own = lambda v, i: F.when(i.isin(*GRIPPERS), gripper(v)).otherwise(v * F.get(signs, i))
    return F.transform(x, own)


def decode_state(state: Column) -> Column:
    """Joints in the model's directions, grippers as angles."""
    return _joints(state, gripper_to_angular)


def encode_actions(actions: Column) -> Column:
    """Of each action of a chunk: joints in the robot's directions, grippers on its scale."""
    return F.transform(actions, lambda a: _joints(a, gripper_from_angular))


def encode_actions_inverse(actions: Column) -> Column:
    return F.transform(actions, lambda a: _joints(a, gripper_from_angular_inverse))


def axis_angle(x: Column, y: Column, z: Column, w: Column) -> Column:
    """A quaternion as an axis times an angle; no rotation where w is close to 1 or -1."""
    w = clip(w, -1.0, 1.0)
    den = F.sqrt(1 - w * w)
    angle = 2 * F.acos(w)
    return F.array(*[F.when(den < 1e-9, 0.0).otherwise(c * angle / den) for c in (x, y, z)])


def binary_gripper(x: Column) -> Column:
    return F.when(x > 0.5, 1.0).otherwise(0.0)


def clip_action(action: Column) -> Column:
    """The last dimension as open or shut, and all within -1 to 1."""
    return F.transform(action, lambda v, i: clip(F.when(i == F.size(action) - 1, binary_gripper(v)).otherwise(v), -1.0, 1.0))


def degrees(x: Column) -> Column:
    return x * (180 / math.pi)
